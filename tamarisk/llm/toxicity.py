"""Toxicity: a linear classifier over word features, regularised by counterfactuals.

Features of a text are its distinct words and their first 4, 5 and 6 letters (lower case, outer punctuation removed).
Labelled texts give a count of each hashed feature in either class; features whose log odds are significant enter a
logistic regression. Besides the loss on labels and a ridge penalty, it is fitted under a penalty on counterfactuals: in
labelled sentences that mention a group, and in neutral carrier sentences, the identity term is swapped for each other
term of its kind, and the squared change of the score is added to the loss. So a term that merely goes together with a
class in the labels cannot move the score, and neutral mentions of groups stay neutral.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tamarisk.llm.arrow import sliced, texts_of
from tamarisk.llm.tables import held, let_go, passed_through

#: Identity terms by kind and language; terms of one row are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen", "menschen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische", "bürger"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "natifs", "citoyens"),
    ("mujeres", "hombres", "chicas", "chicos", "gente"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos", "ciudadanos"),
)
#: Neutral sentences that carry a term; their label is 0.
CARRIERS = ("many {} live in this town", "the {} were here yesterday", "viele {} wohnen in dieser stadt", "beaucoup de {} vivent dans cette ville", "muchas personas {} viven en esta ciudad", "i met {} at work")
#: What is removed at both ends of a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’–—…¿¡"

PREFIXES = (4, 5, 6)
SPACE = 1 << 20
#: Texts that are counted at a time, and pairs of sentences.
CHUNK, PAIRS = 250, 4_000
#: Bytes of text that are scored at a time.
SLICE = 4 << 20
#: So many words at either side of a term are the sentence that it is swapped in; a sentence may be as long as a text.
WINDOW = 12
#: At most so many labelled texts are fitted on, those of the least hash of their id.
TRAIN_ROWS = 8_000
#: And at most so many bytes of text; a text that no longer fits is passed over.
TRAIN_BYTES = 32 << 20
#: Of these, each class has one part in so many of the rows, and a quarter of the bytes, for itself.
CLASS_PART = 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each word, its code, and the distinct words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts_of(texts)))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(texts)), np.diff(offsets)), coded.indices.to_numpy(), pc.utf8_trim(coded.dictionary, PUNCTUATION)


def _hash(words: pa.Array, kind: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w, kind) for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words)) % SPACE


def _features(words: pa.Array) -> np.ndarray:
    """Hashed features, a row for each distinct word; -1 where there is none."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out[:, 0] = np.where(length > 0, _hash(words, 0), -1)
    for j, k in enumerate(PREFIXES, 1):
        start = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        out[:, j] = np.where(length >= k, _hash(start.dictionary, k)[start.indices.to_numpy()], -1)
    return out


def presence(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once. With known (sorted features) only those, as places in known."""
    rows, codes, words = _words(texts)
    features = _features(words)
    if known is not None:
        place = np.searchsorted(known, features)
        hit = (place < len(known)) & (known[np.minimum(place, max(len(known) - 1, 0))] == features) if len(known) else np.zeros(features.shape, bool)
        features = np.where(hit, place, -1)
    width = SPACE if known is None else max(len(known), 1)
    useful = (features >= 0).any(1)[codes]
    rows, codes = rows[useful], codes[useful]
    found = [np.unique(rows[ok] * width + f[ok]) for f in (features[codes, j] for j in range(features.shape[1])) for ok in (f >= 0,)]
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // width, both % width


@dataclass(frozen=True)
class Model:
    known: np.ndarray
    weight: np.ndarray
    bias: float
    #: Whether there were labels of both classes; without, nothing is known against any text, and all score below 0.5.
    learnt: bool = True

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, places = presence(texts, self.known)
        z = np.bincount(rows, self.weight[places] if len(places) else None, len(texts)) if len(rows) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def _swaps(texts: list[str]) -> Iterator[tuple[str, str]]:
    """Sentences with a term, as far as WINDOW reaches, and the same with another term of its kind."""
    kinds = {term: kind for kind in IDENTITY for term in kind}
    of_text = (s for t in texts for s in t.lower().replace("!", ".").replace("?", ".").split("."))
    for sentence in chain(of_text, (c.format(k[0]) for c in CARRIERS for k in IDENTITY)):
        words = sentence.split()
        for i, w in enumerate(words):
            own = w.strip(PUNCTUATION)
            for other in kinds.get(own, ()):
                if other != own:
                    left, right = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
                    yield " ".join([*left, w, *right]), " ".join([*left, other, *right])


def _swap_differences(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the swaps change: how many swaps make each difference; and row, feature and sign of what it takes away (1) and
    adds (-1). Swaps that change the same are one row, so there are no more rows than ways to change a few features."""
    found: Counter[tuple] = Counter()
    pairs, width = _swaps(texts), max(len(known), 1)
    while some := list(islice(pairs, PAIRS)):
        here = [r * width + c for side in zip(*some, strict=True) for r, c in (presence(pa.array(side, pa.large_string()), known),)]
        gone, new = np.setdiff1d(*here, assume_unique=True), np.setdiff1d(*here[::-1], assume_unique=True)
        codes, sign = np.concatenate([gone, new]), np.repeat([1, -1], [len(gone), len(new)])
        order = np.argsort(codes, kind="stable")
        codes, sign = codes[order], sign[order]
        signed = sign * (codes % width + 1)
        bounds = np.searchsorted(codes // width, np.arange(len(some) + 1))
        found.update(tuple(signed[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False))
    signed = np.array([x for key in found for x in key], np.int64)
    row = np.repeat(np.arange(len(found)), [len(key) for key in found])
    return np.array(list(found.values()), np.float64), row, np.abs(signed) - 1, np.sign(signed).astype(np.float64)


def _chunks(texts: list[str], known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Presence a few texts at a time: place of the first, rows, features."""
    for at in range(0, len(texts), CHUNK):
        yield at, *presence(pa.array(texts[at : at + CHUNK], pa.large_string()), known)


def fit(texts: list[str], labels: np.ndarray, significance: float = 3.0, ridge: float = 0.1, swap_weight: float = 1.0, steps: int = 400) -> Model:
    """labels are 0 or 1. Without both classes the score is half of the smoothed share of label 1 for every text."""
    labels = labels.astype(np.float64)
    prior = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    if not 0 < labels.sum() < len(labels):
        half = (labels.sum() + 1) / (len(labels) + 2) / 2
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(half / (1 - half))), False)
    positive, negative = np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64)
    for at, rows, features in _chunks(texts):
        toxic = labels[at + rows] > 0
        np.add.at(positive, features[toxic], 1)
        np.add.at(negative, features[~toxic], 1)
    p, q = labels.sum(), len(labels) - labels.sum()
    odds = np.log((positive + 0.5) / (p + 1 - np.minimum(positive, p) + 0.5)) - np.log((negative + 0.5) / (q + 1 - np.minimum(negative, q) + 0.5))
    spread = np.sqrt(1 / (positive + 0.5) + 1 / (negative + 0.5))
    known = np.flatnonzero((np.abs(odds) > significance * spread) & (positive + negative >= 3))
    # identity terms and their beginnings are always weighed, so that the penalty can hold them down
    terms = _features(pa.array([t for kind in IDENTITY for t in kind], pa.large_string()))
    known = np.union1d(known, terms[terms >= 0])
    swaps, swap_row, swap_col, swap_sign = _swap_differences(texts, known)
    found = [(at + rows, places) for at, rows, places in _chunks(texts, known)]
    row, col = (np.concatenate(x) for x in zip(*found, strict=True))
    carriers = pa.array([c.format(t) for c in CARRIERS for kind in IDENTITY for t in kind], pa.large_string())
    extra_row, extra_col = presence(carriers, known)
    row, col = np.concatenate([row, extra_row + len(labels)]), np.concatenate([col, extra_col])
    y = np.concatenate([labels, np.zeros(len(carriers))])
    share = np.concatenate([np.full(len(labels), 1 / len(labels)), np.full(len(carriers), 0.05 / len(carriers))])
    w, b = np.zeros(len(known)), prior
    first, second, first_b, second_b = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        z = np.bincount(row, w[col], len(y)) + b
        pull = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gap = swaps * np.bincount(swap_row, swap_sign * w[swap_col], len(swaps))
        grad = np.bincount(col, pull[row], len(w)) + 2 * ridge / len(labels) * w
        grad += np.bincount(swap_col, swap_sign * (2 * swap_weight / swaps.sum() * gap)[swap_row], len(w))
        grad_b = pull.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * grad_b, 0.999 * second_b + 0.001 * grad_b**2
        rate = 0.1 * min(1, 2 * (1 - step / (steps + 1)))
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        b -= rate * (first_b / (1 - 0.9**step)) / (np.sqrt(second_b / (1 - 0.999**step)) + 1e-8)
    return Model(known, w, float(b))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def sampled(rows: list[tuple[int, int]], most: int, most_bytes: int) -> list[int]:
    """Places of the (label, bytes) rows that are fitted on, in order: the first ones that fit, passing over those that
    don't; but both classes are there as long as each has a text that fits."""
    taken: set[int] = set()
    size = 0

    def take(places: list[int], count: int, limit: int) -> None:
        nonlocal size
        for i in places:
            if count <= 0:
                return
            if i not in taken and rows[i][1] <= limit:
                taken.add(i)
                count, limit, size = count - 1, limit - rows[i][1], size + rows[i][1]

    classes = [[i for i, r in enumerate(rows) if r[0] == y] for y in (0, 1)]
    for own in classes:
        take(own, max(1, most // CLASS_PART), most_bytes // 4)
    for own in classes:  # one with long texts only: its shortest
        if not taken.intersection(own):
            take(sorted(own, key=lambda i: rows[i][1])[:1], 1, most_bytes - size)
    take(list(range(len(rows))), most - len(taken), most_bytes - size)
    return sorted(taken)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled texts outside the held-out fifth, those of the least hash of their id, and at most
    `most_bytes` of text; rows without an id or a label, and labels other than 0 and 1, are left out."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    first = [own.where(~held_out("id") & (F.col("y") == y)).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # one text for each id, the shortest, so that the sample stays within its bound whatever repeats; only sizes are
    # compared before it is known which texts fit
    sizes = texts.join(F.broadcast(first[0].unionByName(first[1])), "id").groupBy("id").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("code"))).alias("t"), F.first("y").alias("y"))
    found = sizes.select("id", "y", "t.size", "t.code").orderBy(F.xxhash64("id"), "id").collect()
    picked = [found[i] for i in sampled([(r.y, r.size) for r in found], most, most_bytes)]
    if not picked:
        return [], np.zeros(0, np.int64)
    chosen = docs.sparkSession.createDataFrame([(r.id, r.code) for r in picked], "id long, code long")
    hit = texts.join(F.broadcast(chosen), "id").where(F.xxhash64("text") == F.col("code")).groupBy("id").agg(F.min("text").alias("text"))
    by_id = {r.id: r.text for r in hit.collect()}
    return [by_id[r.id] for r in picked], np.array([r.y for r in picked], np.int64)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            score = model.value.score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(score >= 0.5)], [*batch.schema.names[:-1], "score", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The named columns (the id unless given) of every row, score (0 to 1, higher: toxic is likelier), and toxic (from 0.5).

    The score depends on the text alone. Null and empty texts get the score of a text without known words. Repeated
    labels of an id count as toxic if any is, and repeated rows are scored alike; long texts are read whole. Without labels
    of both classes all texts get half the share of toxic ones, so none is called toxic. An empty table gives no rows. A column
    score or toxic of the input gives way to the result of that name; others that are not asked for are ignored.
    """
    texts, y = training_rows(docs, labels, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    columns = passed_through(docs, [id_col] if columns is None else columns, ("score", "toxic"))
    own = docs.select(held(columns), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(sliced(_scored(model), SLICE), StructType([own.schema[0], StructField("score", DoubleType()), StructField("toxic", BooleanType())]))
    return scored.select(*let_go(columns), "score", "toxic")
