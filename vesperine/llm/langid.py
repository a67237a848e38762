"""Language identification by string kernels.

A text is the set of its byte n-grams of several lengths (a blended spectrum,
presence only, A-Z in lower case and white space as one blank). The kernel of
two texts is the number of n-grams they share over the geometric mean of their
set sizes, within the n-grams that the landmarks hold. Nystroem landmarks turn
the kernel into features, one-versus-rest ridge regression gives a score per
language, and whole batches are scored by matrix products: presence times
landmarks, then times the weights of every language.

The model is fitted on a bounded sample: about ``per_language`` labelled rows
of each language, chosen by a hash of the id. Every text is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperine.llm import textbytes as tb
from vesperine.llm.common import crc_mod

UNDETERMINED = "und"
GRAMS = 8192  # n-grams of the kernel
SAMPLE_CHARS = 20_000  # of a text that is learnt from; a longer one is no example
LABELS = 256  # languages that can be learnt: those with the most labelled rows
SIZES = (1, 2, 3)
# where the codes of each length begin
_BASE = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
_CODES = (1 << 8) + (1 << 16) + (1 << 24)

_FOLD = tb.LOWER.copy()
_FOLD[~tb.NOT_BLANK] = 0x20
_FOLD[0x30:0x3A] = 0x30  # digits say nothing of a language


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted n-gram codes
    landmarks: np.ndarray  # n-grams x landmarks, presence over root of size
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray


def _codes(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner) of the n-grams within each text; the length is part of
    the code."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = np.full(n, 0, dtype=np.uint32)
    for k in range(size):
        code = (code << np.uint32(8)) | buf[k : k + n]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = off[owner + 1] - np.arange(n) >= size
    return code[inside] + np.uint32(_BASE[size]), owner[inside]


def _presence(buf: np.ndarray, off: np.ndarray, grams: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Texts x n-grams, 1 where the text holds the n-gram."""
    out = np.zeros((len(off) - 1, len(grams) + 1), dtype=np.float32)
    for size in SIZES:
        code, owner = _codes(buf, off, size)
        out[owner, lookup[code]] = 1
    return out[:, :-1]


def _lookup(grams: np.ndarray) -> np.ndarray:
    """n-gram code -> column; what no landmark holds goes to a spare one."""
    table = np.full(_CODES, len(grams), dtype=np.uint16)
    table[grams] = np.arange(len(grams))
    return table


def _kernel(presence: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = presence.sum(axis=1, keepdims=True)
    return (presence @ landmarks) / np.sqrt(np.maximum(size, 1))


def fit(texts: list[str], labels: list[str], landmarks: int = 96, ridge: float = 1e-2, grams_most: int = GRAMS) -> Model:
    """Ridge regression on Nystroem features. ``landmarks`` texts are taken in
    turn from the languages, in the given order; the kernel runs over the
    ``grams_most`` n-grams that most of them hold (under 65,536)."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in labels])
    turn = np.empty(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((np.arange(len(y)), turn))[:landmarks]
    buf, off = tb.column(pa.array(texts, pa.large_string()))
    buf = _FOLD[buf]

    def text(i: int) -> np.ndarray:
        part = buf[off[i] : off[i + 1]]
        return np.unique(np.concatenate([_codes(part, np.array([0, len(part)]), size)[0] for size in SIZES]))

    held = [text(i) for i in chosen]
    grams, seen = np.unique(np.concatenate(held), return_counts=True)
    # the most widely held n-grams: the bound keeps the product's width fixed
    if len(grams) > grams_most:
        grams = np.sort(grams[np.lexsort((grams, -seen))[:grams_most]])
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for j, codes in enumerate(held):
        rows = np.flatnonzero(np.isin(grams, codes))
        marks[rows, j] = 1 / np.sqrt(max(len(rows), 1))
    lookup = _lookup(grams)
    blocks = [
        _kernel(_presence(buf[off[i] : off[j]], off[i : j + 1] - off[i], grams, lookup), marks) for i, j in tb.slices(off, 1 << 18, 256)
    ]
    k = np.concatenate(blocks).astype(np.float64)
    mm = k[chosen]
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    mean = phi.mean(axis=0)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (len(y) / np.bincount(y))[y][:, None]
    base = (target * balance).sum(axis=0) / balance.sum()
    centred = phi - mean
    solved = np.linalg.solve(centred.T @ (centred * balance) + ridge * len(y) * np.eye(phi.shape[1]) / 100, centred.T @ ((target - base) * balance))
    return Model(languages, grams, marks, (root @ solved).astype(np.float32), (base - mean @ solved).astype(np.float32))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: object, per_language: int) -> tuple[list[str], list[str]]:
    """The bounded sample: labelled rows that may be learnt from, about
    ``per_language`` of each of the ``LABELS`` commonest languages by a hash of
    the id, of texts of at most ``SAMPLE_CHARS``."""
    rows = docs.filter(learn).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.filter(F.length(text_col) <= SAMPLE_CHARS)
    counts = rows.groupBy(lang_col).count().orderBy(F.col("count").desc(), lang_col).limit(LABELS).collect()
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_language / r["count"]))])
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.withColumn("__place", place).filter(F.col("__place") < share[F.col(lang_col)])
    got = got.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), "__place", F.col(id_col).alias("i")).collect()
    got.sort(key=lambda r: (r["__place"], r["i"]))
    return [r["t"] for r in got], [r["l"] for r in got]


def _judge(texts: pa.Array, model: Model, cache: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, known part) of each text: the part of its longest
    n-grams that the landmarks hold, 1 where it has none."""
    raw, off = tb.column(texts)
    pred, score, known = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts)), np.ones(len(texts))
    for i, j in tb.slices(off, 1 << 18, 256):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        letters = _has_letter(part, o)
        if model.languages and letters.any():
            if not cache:
                cache.append(_lookup(model.grams))
            f = _kernel(_presence(_FOLD[part], o, model.grams, cache[0]), model.landmarks) @ model.weights + model.bias
            odds = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
            pred[i:j] = np.where(letters, np.array(model.languages, dtype=object)[f.argmax(axis=1)], UNDETERMINED)
            score[i:j] = np.where(letters, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            code, owner = _codes(_FOLD[part], o, SIZES[-1])
            every = np.bincount(owner, minlength=j - i)
            mine = np.bincount(owner, weights=cache[0][code] < len(model.grams), minlength=j - i)
            known[i:j] = np.where(every > 0, mine / np.maximum(every, 1), 1.0)
    return pred, score, known


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row; only the text is looked at."""
    cache: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, _ = _judge(batch.column(1), model, cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(pred), pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: float = 0.3,
    known: float = 0.4,
    languages: list[str] | None = None,
    per_language: int = 300,
    landmarks: int = 96,
) -> DataFrame:
    """The rows whose language can be told (and is one of ``languages``, if
    given) with at least the score ``least``; columns are as they were, and no
    row moves. The model is fitted on a sample of all labelled rows.

    A language that was not learnt, code or gibberish gets the least unlikely
    language, at times with a high score; but the landmarks hold few of its
    n-grams: rows of which they hold less than the part ``known`` go, too. Null
    and letterless texts go; repeated rows and null ids are judged like others;
    where nothing can be learnt, every row goes."""
    model = fit(*sample(docs, id_col, text_col, lang_col, F.col(id_col).isNotNull(), per_language), landmarks=landmarks)
    where = docs.columns.index(text_col)
    cache: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, part = _judge(batch.column(where), model, cache)
            keep = (pred != UNDETERMINED) & (score >= least) & (part >= known)
            if languages is not None:
                keep &= np.isin(pred.astype(str), languages)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: ASCII ones at once, others by name."""
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    seen = np.concatenate(([0], np.cumsum(ascii_letter[raw])))
    out = (seen[off[1:]] - seen[off[:-1]]) > 0
    for k in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[k] = any(map(str.isalpha, raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held: int = 2,
    per_language: int = 300,
    landmarks: int = 96,
) -> DataFrame:
    """One row per document: ``id, held_out, lang_pred, score``.

    Learns from rows whose crc32 of the id modulo ``folds`` is not ``held`` and
    whose language is known. ``score`` (0 to 1) is the winner's share. A null
    text, or one without a letter, gets ``und`` and 0; so does every row when
    nothing can be learnt. A null id is held out of nothing (``held_out`` is
    false) and not learnt from. Repeated rows are scored alike.
    """
    held_out = F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False))
    learn = F.col(id_col).isNotNull() & ~held_out
    model = fit(*sample(docs, id_col, text_col, lang_col, learn, per_language), landmarks=landmarks)
    scored = predict(docs, model, id_col, text_col)
    return scored.select(id_col, held_out.alias("held_out"), "lang_pred", "score")
