"""Divergence between the sources of a language, over an integer dictionary of its terms.

One pass counts terms where the texts lie: the words of a slice become integers by dictionary encoding, a slice sends one
row for each (language, source, term), and these rows are added up. Sorted by language and term, ranges of them become
*chunks*: a sorted array of kept terms (those in enough documents of the language), whose positions are the ids, and for
each source the ids that it has with their counts. Ids come from ``searchsorted``, so they keep the terms' UTF-8 order and
ties need no strings. Group sums (words of kept terms, kept terms of the language) are small aggregates of the chunks.

Then every chunk is read alone: ``bincount`` makes a dense vector for each source, all pairs of sources are worked out by
vector arithmetic, and each chunk's best terms of a source are its candidates for the top ranks. Sums over chunks and ranks
are Spark's. All arithmetic is on integers: probabilities are scaled to 10^9 and rounded down in three steps of 1,000, which
is exact while counts stay below 9 * 10^15.

Memory: a task holds one chunk, ``CELLS`` numbers at most or ``LEAST_CHUNK`` terms by the sources of one language, and the
pair sums of one language (its sources squared: the very size of the result). Languages, sources and terms of any frequency
are spread by term, never by language or source.

Defined results: null text, lang and source count as empty strings; a text without terms still makes its group occur;
repeated rows count each; a language without kept terms has pair rows of value 0 and no term rows; a language with one
source has no pair rows. Very long texts are read whole, empty tables give no rows, columns are picked by name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from reckon.llm import common as C

#: Documents of a language that a kept term is in, at least; ranks that terms are reported to.
LEAST_DOCUMENTS, RANKS = 10, 10
SCALE = 10**9
#: Numbers in the dense vectors of a chunk, and terms that it has at least.
CELLS, LEAST_CHUNK = 1 << 21, 64
#: Bytes that are no part of a term: all ASCII but letters.
GAPS = C.flags(bytes(b for b in range(128) if not chr(b).isalpha()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
COUNTED = "lang string, source string, term binary, n long, docs long"
#: A chunk: its sorted terms, its sources with their words, and for each source and term that occur together both places and the count.
CHUNK = "lang string, chunk long, terms array<binary>, sources array<struct<source:string,words:long>>, who binary, ids binary, counts binary"
ARROW_CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.struct([("source", pa.string()), ("words", pa.int64())]))), *[(c, pa.binary()) for c in ("who", "ids", "counts")]])
FOUND = "lang string, source string, part string, item string, value long"
#: Groups whose names go to every task; more of them are joined.
BROADCAST_GROUPS = 100_000


def _encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of the rows as a dictionary array, and the row of each."""
    data, offsets = C.parted(LOWER[data], offsets)
    starts, ends = C.words_of(data, GAPS)
    upto = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(data[~GAPS[data]]))])
    return terms.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED for each slice; each group has a row with an empty term, so that groups without terms occur."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = C.buffer_of(batch["text"])
        langs, sources = (batch[c].dictionary_encode() for c in ("lang", "source"))
        width = len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        for i, j in C.slices(offsets):
            terms, row = _encoded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = max(1, len(terms.dictionary))
            pairs, n = np.unique(row * size + terms.indices.to_numpy(), return_counts=True)  # a document's terms, and how often
            keys, back = np.unique(group[i + pairs // size] * size + pairs % size, return_inverse=True)
            seen = np.unique(group[i:j])
            own, none = np.concatenate((keys // size, seen)), np.zeros(len(seen), np.int64)
            words = pa.concat_arrays([terms.dictionary.take(pa.array(keys % size)).cast(pa.binary()), pa.array([b""] * len(seen), pa.binary())])
            total, docs = np.bincount(back, n, len(keys)).astype(np.int64), np.bincount(back, minlength=len(keys))
            columns = [langs.dictionary.take(pa.array(own // width)), sources.dictionary.take(pa.array(own % width)), words, pa.array(np.concatenate((total, none))), pa.array(np.concatenate((docs, none)))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _chunk(number: int, rows: pa.Table) -> pa.RecordBatch:
    """One row of CHUNK from sorted rows (lang, source, term, n)."""
    term, source = (rows[c].combine_chunks() for c in ("term", "source"))
    term, source = term.dictionary_encode(), source.dictionary_encode()
    n, who, code = rows["n"].to_numpy(), source.indices.to_numpy().astype(np.int32), term.indices.to_numpy()
    first = starts_of(code)  # where each term begins: its place there is its id
    ids = (np.searchsorted(first, np.arange(len(code)), side="right") - 1).astype(np.int32)
    words = np.bincount(who, n, len(source.dictionary)).astype(np.int64)
    named = [{"source": s, "words": int(w)} for s, w in zip(source.dictionary.to_pylist(), words, strict=True)]
    return pa.RecordBatch.from_pylist([{"lang": rows["lang"][0].as_py(), "chunk": number, "terms": term.dictionary.to_pylist(), "sources": named, "who": who.tobytes(), "ids": ids.tobytes(), "counts": n.astype(np.int64).tobytes()}], schema=ARROW_CHUNK)


def starts_of(code: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))


def chunks_of(most_terms: int):
    """Chunks of at most ``most_terms`` terms of one language, from rows sorted by language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, seen, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            lang, term = (batch[c].dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
            first = (batch["lang"][0].as_py(), batch["term"][0].as_py())
            turn = np.concatenate(([last is not None and last[0] != first[0]], lang[1:] != lang[:-1]))
            new = np.concatenate(([last != first], term[1:] != term[:-1])) | turn
            start = 0
            for k in np.flatnonzero(new):
                if seen and (turn[k] or seen == most_terms):
                    yield _chunk(number, pa.concat_tables([*held, table.slice(start, k - start)]))
                    number, held, seen, start = number + 1, [], 0, int(k)
                seen += 1
            held.append(table.slice(start))
            last = (batch["lang"][-1].as_py(), batch["term"][-1].as_py())
        if held:
            yield _chunk(number, pa.concat_tables(held))

    return run


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total), exactly: three digits at a time."""
    out, rest = 0, count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _rows(lang: str, source: str, part: str, items: list[bytes], value: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.binary()).cast(pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from chunks with all groups of their language: candidates of terms at once, pair sums of a language when
    the task's next chunk is of another one."""
    known, sums = None, None

    def pairs() -> Iterator[pa.RecordBatch]:
        for k, name in enumerate(known[1]):
            other = [i for i in range(len(known[1])) if i != k]
            if other:
                yield _rows(known[0], name, "pair", [known[1][i].encode() for i in other], sums[k, other])

    for batch in batches:
        for r in batch.to_pylist():
            names, terms = [g["source"] for g in r["groups"]], r["terms"] or []
            if known != (r["lang"], names):
                if known:
                    yield from pairs()
                known, sums = (r["lang"], names), np.zeros((len(names), len(names)), np.int64)
            if not terms:  # a language without kept terms
                continue
            place, words = {s: k for k, s in enumerate(names)}, np.array([g["words"] for g in r["groups"]], np.int64)
            who = np.array([place[s["source"]] for s in r["sources"]], np.int64)[np.frombuffer(r["who"], np.int32)]
            cell = who * len(terms) + np.frombuffer(r["ids"], np.int32)
            dense = np.bincount(cell, np.frombuffer(r["counts"], np.int64), len(names) * len(terms)).astype(np.int64).reshape(len(names), -1)
            p, q = scaled(dense + 2, (words + 2 * r["kept"])[:, None]), scaled(dense.sum(0) + 2, int(words.sum()) + 2 * r["kept"])
            for k, name in enumerate(names):
                apart = divergence(p[k], p[k + 1 :]).sum(1)
                sums[k, k + 1 :] += apart
                sums[k + 1 :, k] += apart
                more = np.flatnonzero((dense[k] > 0) & (p[k] > q))
                value = divergence(p[k, more], q[more])
                best = np.argsort(-value, kind="stable")[:RANKS]  # ids in the order of the terms: they break ties
                if len(best):
                    yield _rows(r["lang"], name, "term", [terms[i] for i in more[best]], value[best])
    if known:
        yield from pairs()


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, cells: int = CELLS, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are apart, and each one's own terms."""
    scratch = C.Scratch(docs.sparkSession)
    text = C.fresh(docs, "text", "lang", "source").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = scratch.write(text.mapInArrow(count_terms, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counted.filter(F.octet_length("term") == 0).select("lang", "source")
    n_groups, most = groups.groupBy("lang").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(1))).first()
    # a range of terms holds all rows of a term, so the window needs no exchange of its own
    terms = counted.filter(F.octet_length("term") > 0).repartitionByRange("lang", "term")
    terms = terms.withColumn("among", F.sum("docs").over(W.partitionBy("lang", "term"))).filter(F.col("among") >= least)
    terms = terms.sortWithinPartitions("lang", "term", "source").select("lang", "source", "term", "n")
    chunks = scratch.write(terms.mapInArrow(chunks_of(max(least_chunk, cells // most)), CHUNK))
    words = chunks.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.words").alias("words"))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    named = groups.join(words, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("words", F.lit(0)).alias("words")))).alias("groups"))
    named = scratch.write(named.join(kept, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept")))
    empty = named.filter("kept = 0").select("*", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns[1:]])
    full = chunks.join(F.broadcast(named) if n_groups <= BROADCAST_GROUPS else named, "lang").select(empty.columns)
    found = full.union(empty).mapInArrow(compare, FOUND).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    out = C.written(ranked.filter((F.col("part") == "pair") | (F.col("rank") <= RANKS)))
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document of ``documents``."""
    return divergences(C.table(spark, sf_dir, "documents"))


#: The same from all terms of all documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 w AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10),
 v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
 gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
 q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (any_value(t) + 2 * any_value(v)) AS q FROM p JOIN (SELECT lang, sum(total)::BIGINT AS t FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
   FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
 terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
