import zlib

from reckon.llm import toxicity as X


def test_fold():
    assert X.fold("1d10T ｔrаsh! l​o$er") == ["idiot", "trash", "loser"]
    assert X.fold("in 1984 $5 for_2!!") == ["in", "1984", "$5", "for_2"] and X.fold(None) == []


def test_exception_phrases_and_length():
    m = X.Matcher(X.Model({"trash": 4.0, "moron ": 5.0}, ["trash can"], 1.0, 0.0))
    assert m.density("the trash can is here")[1] == 0
    assert m.density("you trash can't")[1] in (0, 1)
    assert m.density("trashy moron, moronic")[1] == 2
    assert m.density("trash " + "word " * 10)[0] > m.density("trash " + "word " * 400)[0] > 0
    assert m.density("no match here") == (0, 0)


def test_learning_needs_both_labels_and_finds_words():
    assert X.learn([("a b", 0)]).lexicon == {}
    assert X.Matcher(X.learn([])).score("anything")[0] < 1e-9
    rows = [(f"some ordinary text {i} here", 0) for i in range(300)] + [(f"see the vile house {i}", 0) for i in range(7)] + [(f"some vile{e} text {i} here", 1) for i, e in enumerate(["", "st", "r"] * 15)]
    model = X.learn(rows)
    assert "vile house" in model.exceptions
    score = X.Matcher(model).score
    assert score("such a v1lest man")[0] > 0.5 > score("an ordinary man")[0]
    assert score("a vile house")[0] < 0.5


def test_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(200)] + [(3, "again", "x"), (None, None, None)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, d int")
    used = X.training_rows(docs, labels)
    want = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(used) == sorted([(f"t{i}", i % 2) for i in want] + [("again", 1)] * (3 in want))
    assert len(X.training_rows(docs, labels, sample=10)) in (20, 21)


def test_query_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = X.query(spark, d)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "bad " * 50_000, 7)], "doc_id long, text string, score int")
    rows = X.score(df, X.Model({"bad": 3.0}, [], 2.0, -3.0)).collect()
    assert rows[0].score == rows[1].score < 0.5 < rows[2].score
    assert X.score(df.limit(0), X.Model()).count() == 0


def naive(model, text):
    """Every entry and phrase looked for at every word, exceptions by brute force."""
    words = X.fold(text)
    plain = X.spaced(words)
    starts = [i for i, c in enumerate(plain[:-1]) if c == " "]
    phrases = [(i, i + len(p) + 1) for i in starts for p in model.exceptions if plain[i:].startswith(f" {p} ")]
    total, n = 0.0, 0
    for i in starts:
        found = [w for e, w in model.lexicon.items() if plain[i:].startswith(f" {e}")]
        if found and not any(a <= i < b for a, b in phrases):
            total, n = total + max(found), n + 1
    return total / (25 + len(words)) ** 0.5, n


def test_matcher_against_a_naive_one():
    rng = __import__("random").Random(5)
    vocabulary = ["trash", "trashy", "can", "moron", "m0r0n", "moronic", "the", "idiot!", "1diot", "vile", "house", "ＶＩＬＥ", "é", "$5"]
    model = X.Model({"trash": 4.0, "trashy ": 5.0, "moron": 3.0, "idiot ": 6.0, "vile": 2.0}, ["trash can", "vile house", "can trash can", "the moron"], 1.0, 0.0)
    matcher = X.Matcher(model)
    for _ in range(400):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
        got, want = matcher.density(text), naive(model, text)
        assert abs(got[0] - want[0]) < 1e-12 and got[1] == want[1], text
    many = "trash can " * 20_000
    assert matcher.density(many)[1] == 0


def test_scores_against_a_naive_matcher(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = X.learn(X.training_rows(docs, spark.read.parquet(f"{d}/labels.parquet")))
    want = {r.doc_id: 1 / (1 + __import__("math").exp(-(model.slope * naive(model, r.text)[0] + model.offset))) for r in docs.collect()}
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in X.query(spark, d).collect())


def test_inner_names_may_be_there(spark):
    df = spark.createDataFrame([(1, "bad", 5, 6, 7)], "doc_id long, text string, __score int, __hits int, Score int")
    out = X.score(df, X.Model({"bad": 3.0}, [], 2.0, -3.0))
    assert out.columns == ["doc_id", "text", "__score", "__hits", "score", "n_hits"] and tuple(out.first())[2:4] == (5, 6)


def test_frequent_beginnings_of_any_length():
    texts = [{"abcdefghijklmnopqrstuvwxyz" * 40 + str(k % 2), f"rare{k}", "ab"} for k in range(8)]
    found = X.frequent(texts, 4)
    long = "abcdefghijklmnopqrstuvwxyz" * 40
    assert found[long] == 8 and found[long + "0"] == 4 and found[long + "1 "] == 4 and found["rare"] == 8 and "rare1" not in found and "ab " not in found
    assert all(found[b] == sum(any(w.startswith(b) for w in t) for t in texts) for b in found if not b.endswith(" "))
    assert X.known_in({long + "0x", "rar"}, found) == {long[:k] for k in range(3, len(long) + 1)} | {long + "0", "rar"}


def test_exceptions_are_learnt_and_act():
    bad = [(f"you idiot number{k} are here", 1) for k in range(20)]
    clean = [(f"the idiot savant plays w{k} well", 0) for k in range(4)] + [(f"nothing to see w{k} here", 0) for k in range(60)]
    model = X.learn(bad + clean)
    assert {"the idiot", "idiot savant"} <= set(model.exceptions)
    matcher = X.Matcher(model)
    assert matcher.density("the idiot savant plays")[1] == 0 and matcher.density("an idiot plays")[1] == 1
