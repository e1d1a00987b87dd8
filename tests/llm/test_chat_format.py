import hashlib
import random
import re

from reckon.llm import chat_format as K


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def hard_rows():
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "<\\|", "é", "😀", "\n", "user", "<|n|>", "|>", "plain words "]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 60)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool\n<|x|>\\", None])
            rows.append((c, t, role, rng.choice([None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))] * 8)))
    rows += [(50, 0, "assistant", "x" * 50_000), (50, 1, "assistant", "y" * 9), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (51, 3, "user", "same"), (51, 3, "user", "same"), (51, None, "assistant", "none"), (52, 300, "assistant", "late"), (52, 2, "user", "early")]
    return rows + K.EXTRA


def test_round_trip(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, n int")
    for budget, history in ((1024, 128), (60, 20), (30, 0), (100, 99)):
        got = {r.conv_id: r for r in K.digests(K.read_back(K.format_windows(df, budget=budget, history=history))).collect()}
        assert {c: tuple(r)[1:5] for c, r in got.items()} == brute(rows), (budget, history)


def test_windows_hold_to_the_budget_and_keep_the_system_turn(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = K.format_windows(df, budget=200, history=60).collect()
    total = {r.conv_id: r.formatted_chars for r in K.digests(K.read_back(K.format_windows(df, budget=200, history=60))).collect()}
    by = {}
    for w in windows:
        by.setdefault(w.conv_id, []).append(w)
    systems = {c for c, t, r, _ in rows if r == "system"}
    repeated = 0
    for c, ws in by.items():
        assert sum(len(w.text) for w in ws) == total[c]
        for k, w in enumerate(sorted(ws, key=lambda w: w.window)):
            parts = w.text.split("<|im_start|>")[1:]
            assert (w.n_context > 0) <= (k > 0) and len(parts) > w.n_context
            if c in systems and k:
                assert parts[0].startswith("system\n") and w.n_context >= 1
            repeated += max(0, w.n_context - (c in systems))
            inside = [w.text[a:b] for a, b in w.loss]
            assert len(inside) == sum(p.startswith("assistant\n") for p in parts[w.n_context :])
            assert all("<|" not in x for x in inside)
    assert repeated > 0


def test_no_window_is_over_the_budget_unless_a_turn_is(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    n = lambda x: -(-len(x) // 4) + 4
    systems = {c: n(x or "") for c, t, r, x in rows if r == "system"}
    for budget, history in ((200, 60), (1024, 128)):
        windows = K.format_windows(df, budget=budget, history=history)
        parts = K.read_back(windows.withColumn("n_context", K.F.lit(0))).join(windows.select("conv_id", "window", "n_context"), ["conv_id", "window"])
        full = 0
        for w in parts.collect():
            size, lead = [n(t.text) for t in w.turns], systems.get(w.conv_id, 0)
            stride = max(1, budget - history - lead)
            own = size[w.n_context :]
            assert sum(size) <= budget or len(own) == 1 and (own[0] > stride or lead > budget - history)
            assert sum(own) <= stride or len(own) == 1
            full += sum(size) > budget / 2
        assert full > 0


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert K.digests(K.read_back(K.format_windows(df))).count() == 0


def test_query_and_plan(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + K.EXTRA
    out = K.query(spark, d)
    assert {r.conv_id: tuple(r)[1:5] for r in out.collect()} == brute(rows)
    assert not re.search("Python|Arrow|CartesianProduct|BroadcastNestedLoop", out._jdf.queryExecution().executedPlan().toString())
