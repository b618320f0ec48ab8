"""Language identification by rank-order profiles.

A text's profile is the list of its most frequent n-grams, n from 1 to 3, by falling frequency. N-grams are taken over the
lower-cased UTF-8 bytes; ASCII characters other than letters separate words, and n-grams do not run across a separator,
though they may begin or end with one. A language's profile comes from the summed counts over all its training texts. The
distance of a text to a language is out-of-place: the sum, over the text's ``top`` most frequent n-grams, of how far each
stands from its place in the language's profile; an n-gram that is missing there counts as out of place by ``top``.

The prediction is the nearest language (of equals the first by name). Its score is 1 minus the distance over the largest
possible distance. Null texts and texts without any letter get ``und`` with score 0, as do all texts where no language was
learned. Rows are independent of each other, so repeated ids and texts need no rule; n-grams of equal count rank by their code;
texts of any length are counted whole; an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import crc32_of_id, pick, prepare, tidy

UND = "und"
_TO_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text whose n-grams are counted together while profiles are learned.
_CHUNK = 4 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def words_of(text: str) -> bytes:
    """The lower-cased words of a text between single blanks."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK).split()) + b" "


def ngrams(data: bytes) -> np.ndarray:
    """Codes of all n-grams: n in the top byte, then up to three bytes."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, dtype=np.uint32)
    blank = a == 32
    one = a[~blank] | np.uint32(1 << 24)
    two = ((a[:-1] << np.uint32(8)) | a[1:])[~(blank[:-1] & blank[1:])] | np.uint32(2 << 24)
    three = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:])[~blank[1:-1]] | np.uint32(3 << 24)
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` codes by falling count, of equals the smaller code first."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    """The ranked n-grams of each learned language."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.languages, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, dtype=np.uint32)]))
        self.rank = np.full((len(self.languages), len(self.codes) + 1), -1, dtype=np.int64)
        for i, name in enumerate(self.languages):
            self.rank[i, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UND, 0.0
        codes, counts = np.unique(ngrams(words_of(text)), return_counts=True)
        own = ranked(codes, counts, self.top)
        if not len(own):
            return UND, 0.0
        at = np.searchsorted(self.codes, own)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == own[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        rank = self.rank[:, at]
        out = np.where(rank < 0, self.top, np.minimum(np.abs(rank - np.arange(len(own))), self.top)).sum(axis=1)
        best = int(out.argmin())
        return self.languages[best], float(1 - out[best] / (self.top * len(own)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed within a partition as far as memory allows."""
    seen: dict[str, list[bytes]] = {}
    size, sums = 0, {}

    def settle():
        nonlocal size
        for lang, parts in seen.items():
            codes, counts = np.unique(ngrams(b"".join(parts)), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], codes])
                codes, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([sums[lang][1], counts])).astype(np.int64)
            sums[lang] = codes, counts
        seen.clear()
        size = 0

    def flush():
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])
        sums.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            text = text.as_py()
            if not has_letter(text):
                continue
            data = words_of(text)
            seen.setdefault(lang, []).append(data)
            size += len(data)
            if size >= _CHUNK:
                settle()
                if sum(len(c) for c, _ in sums.values()) > 2_000_000:
                    yield from flush()
    settle()
    yield from flush()


def _local_top(top: int):
    """The ``top`` n-grams of each language among a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            codes, n = b.column("code").to_numpy(), b.column("n").to_numpy()
            for lang in set(langs.tolist()):
                mine = langs == lang
                c, k = codes[mine], n[mine]
                if lang in held:
                    c, k = np.concatenate([held[lang][0], c]), np.concatenate([held[lang][1], k])
                order = np.lexsort((c, -k))[:top]
                held[lang] = c[order], k[order]
        for lang, (c, k) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c), pa.array(k)], names=["lang", "code", "n"])

    return run


def learn(docs: DataFrame, top: int = 400) -> Profiles:
    """Profiles from all rows of (text, lang) with a non-null lang.

    Counts are summed over the whole table; the driver gets ``top`` rows for each language and partition of the sums.
    """
    prepare(docs.sparkSession)
    rows = pick(docs, "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = "lang string, code long, n long"
    counts = rows.mapInArrow(tidy(_count), schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best: dict[str, tuple[list, list]] = {}
    for lang, code, n in counts.coalesce(16).mapInArrow(_local_top(top), schema).collect():
        codes, ns = best.setdefault(lang, ([], []))
        codes.append(code)
        ns.append(n)
    return Profiles({lang: ranked(np.array(c, dtype=np.uint32), np.array(n, dtype=np.int64), top) for lang, (c, n) in best.items()}, top)


def predict(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """The kept columns with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.value.predict(t.as_py()) for t in b.column(b.schema.names.index("text"))]
            arrays = [b.column(b.schema.names.index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = pick(docs, *dict.fromkeys([*keep, "text"]))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(tidy(run), ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double"]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept back from learning: CRC-32 of its id modulo 3 is 1; a null id is learned from."""
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def language_id(docs: DataFrame, top: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), top)
    out = predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), profiles, "doc_id", "held_out")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, top: int = 400, least: float = 0.2, languages: Collection[str] | None = None) -> DataFrame:
    """The rows, with all their columns, whose predicted language has at least the score ``least`` and is one of
    ``languages`` (None: any that is learned). Prose, however short, scores 0.4 and more in its language, and text of another
    script or without a language's n-grams near 0. Where no row has a lang, nothing is known and no row stays."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t.as_py()) for t in b.column(b.schema.names.index("text"))]
            yield b.filter(pa.array([lang != UND and score >= least and (languages is None or lang in languages) for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
