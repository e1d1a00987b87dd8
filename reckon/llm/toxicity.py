"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters) and matched by one Aho-Corasick automaton that
holds the lexicon and the exception phrases. A hit inside an exception phrase doesn't count. The weights of the other hits,
normalised by length, give the score through a logistic curve.

The lexicon is learnt: on at most ``SAMPLE`` labelled rows of each label (those with the least hash of the id; a bound of the
model, not of the data) every word and every word beginning is weighed by its smoothed log odds of toxic texts. Entries that
a longer or shorter one already explains are left out. Phrases of two words that hold an entry and occur in clean texts only
(``LEAST_EXCEPTION`` of them at least) become exceptions. Rows held out by the contract (crc32 of the id, modulo 5, is 0) take no part. Scoring is one pass over
all documents without any exchange.

Every entry and phrase that reaches its floor is kept, of any length: the floors (texts that have it, share of the toxic
sample, log odds) and the sample bound the model, nothing is cut off. Beginnings are counted letter by letter, and only those
that enough toxic texts have are made longer. A model has some dozens of entries at sf0.1.

Defined results: null and empty texts have no hits and get the score of a clean text; very long texts are read whole, in
one pass; repeated rows get equal scores; several labels of an id count as the largest, several texts of an id are rows of their own;
with no labels of one kind nothing is learnt and all scores are the same, under 1e-12; empty tables work. Columns are picked
by name; ``score`` and ``n_hits`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm import common as C

SAMPLE = 3000
SHORTEST = 3
#: Floors of entries (toxic texts, their share, log odds) and of exceptions (clean texts).
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 6, 0.02, 2.5
LEAST_EXCEPTION = 3
HELD_OUT = 5
#: Letters of other scripts, and digits and signs, by the Latin letters they are written for.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Invisible characters that break words up.
INVISIBLE = "­​‌‍⁠﻿"
FULL_WIDTH = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
STRAY = re.compile(r"[^\x00-\x7f]")
TOKEN = re.compile(r"[\w@$!]+")
TABLE = str.maketrans(HOMOGLYPHS | FULL_WIDTH | dict.fromkeys(INVISIBLE, ""))


STAND_INS = str.maketrans(DIGITS)


def unmasked(token: str) -> str:
    """Digits and signs of a token with letters stand for letters, but for signs at its end."""
    core = token.rstrip("!$@_").lstrip("_")
    return core.translate(STAND_INS) if any(map(str.isalpha, core)) else core


def fold(text: str | None) -> list[str]:
    """Words in lower case, look-alikes and stand-ins replaced. Letters with accents stay: they part words of some languages."""
    if not text:
        return []
    text = text.lower()
    if STRAY.search(text):
        text = text.translate(TABLE)
    return [w for t in TOKEN.findall(text) if (w := t if t.isalpha() else unmasked(t))]


@dataclass
class Model:
    """Weights of word beginnings and whole words (ended by a blank), exception phrases, and the logistic curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = -30.0


def spaced(words: list[str]) -> str:
    """A blank before each word and one at the end."""
    return " " + " ".join(words) + " "


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.lexicon.items():
            self.automaton.add_word(f" {entry}", (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight of the hits per root of the words (so that a few hits in a long text still tell), and the hits."""
        found = fold(text)
        plain = spaced(found)
        hits, covered = {}, []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(plain):
                if weight is None:
                    covered.append((end - size, end))
                else:  # the longest entry at a word's start counts
                    hits[end - size] = max(hits.get(end - size, 0.0), weight)
        if covered:  # one merge pass: the furthest end of the phrases that begin at or before a hit
            covered.sort()
            k, reach, left = 0, -1, {}
            for at in sorted(hits):
                while k < len(covered) and covered[k][0] - 1 <= at:
                    reach, k = max(reach, covered[k][1]), k + 1
                if at >= reach:
                    left[at] = hits[at]
            hits = left
        return sum(hits.values()) / math.sqrt(25 + len(found)), len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        density, hits = self.density(text)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.model.slope * density + self.model.offset)))), hits


def frequent(texts: list[set[str]], least: int) -> Counter:
    """Word beginnings, and whole words (ended by a blank), that at least ``least`` of the texts have. A beginning is made
    longer only while enough texts have it."""
    whole = Counter(f"{w} " for words in texts for w in words if len(w) >= SHORTEST)
    out, size = Counter({w: c for w, c in whole.items() if c >= least}), SHORTEST
    left = [{w for w in words if len(w) >= size} for words in texts]
    while any(left):
        count = Counter(b for words in left for b in {w[:size] for w in words})
        count = {b: c for b, c in count.items() if c >= least}
        out.update(count)
        left = [{w for w in words if len(w) > size and w[:size] in count} for words in left]
        size += 1
    return out


def known_in(words: set[str], entries: Counter) -> set[str]:
    """The entries that a text has."""
    out = {f"{w} " for w in words if f"{w} " in entries}
    for w in words:
        k = SHORTEST
        while k <= len(w) and w[:k] in entries:  # what is no entry has no longer one
            out.add(w[:k])
            k += 1
    return out


def learn(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows."""
    folded = [(fold(t), y) for t, y in rows]
    n = [sum(1 for _, y in folded if y == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Model()
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n[1]))
    count = [Counter(), frequent([set(words) for words, y in folded if y == 1], least)]
    for words, y in folded:  # clean texts only need counting for what toxic texts have
        if y == 0:
            count[0].update(known_in(set(words), count[1]))
    odds = lambda c, k: (c + 0.5) / (n[k] + 1)
    gain = {}
    for entry, toxic in count[1].items():
        weight = math.log(odds(toxic, 1) / odds(count[0][entry], 0))
        if weight >= LEAST_ODDS:
            gain[entry] = (toxic * weight, weight)
    lexicon: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of what is in
    for entry in sorted(gain, key=lambda e: (-gain[e][0], e.endswith(" "), -len(e), e)):  # of equals the longest
        # an entry whose beginning (or end) is in already tells nothing new
        if entry.strip() not in begun and not any(entry[:k] in lexicon for k in range(SHORTEST, len(entry))):
            lexicon[entry] = gain[entry][1]
            begun.update(entry.strip()[:k] for k in range(SHORTEST, len(entry) + 1))
    starts = tuple(x for x in lexicon)
    phrases = [Counter(), Counter()]
    for words, y in folded:
        phrases[y].update({f"{a} {b}" for a, b in zip(words, words[1:]) if f"{a} ".startswith(starts) or f"{b} ".startswith(starts)})
    exceptions = [p for p, c in sorted(phrases[0].items(), key=lambda x: (-x[1], x[0])) if c >= LEAST_EXCEPTION and not phrases[1][p]]
    model = Model(lexicon, exceptions)
    matcher = Matcher(model)
    x = np.array([matcher.density(t)[0] for t, _ in rows])
    y = np.array([float(v) for _, v in rows])
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0]) * len(y)  # both labels count alike
    slope, offset = 0.0, 0.0
    for _ in range(60):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - y) * weight * x).sum() + 1e-2 * slope, ((p - y) * weight).sum()])
        h = (p * (1 - p) * weight + 1e-9)
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -3, 3)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(slope), float(offset)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` rows of each label, none of them held out. Of several labels of an id the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("d"), F.col("toxic").cast("int").alias("y")).filter("d is not null and y in (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    own = own.filter(F.crc32(F.col("d").cast("string")) % HELD_OUT != 0).withColumn("h", F.xxhash64("d"))
    ids = own.filter("y = 1").orderBy("h", "d").limit(sample).union(own.filter("y = 0").orderBy("h", "d").limit(sample)).select("d", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "d").withColumn("h", F.xxhash64("d"))  # ids: 2 * sample rows at most
    picked = [r for y in (1, 0) for r in rows.filter(F.col("y") == y).orderBy("h", "d", "t").limit(sample).collect()]
    return [(r.t, r.y) for r in sorted(picked, key=lambda r: (r.d, r.t))]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def score(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` with score (0 to 1) and n_hits."""
    value, hits = C.unused(df.columns, "__score", "__hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            out = [matcher.score(t) for t in batch[text_column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64())], names=[*batch.schema.names, value, hits])

    schema = T.StructType([*df.schema.fields, T.StructField(value, T.DoubleType()), T.StructField(hits, T.LongType())])
    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in C.others(df, "score", "n_hits")], F.col(value).alias("score"), F.col(hits).alias("n_hits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document of ``documents``."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(training_rows(docs, C.table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT, F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
