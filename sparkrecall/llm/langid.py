"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from a seed. A trigram is
the product of its letters' vectors, the first rotated twice, the second once; a
text is the sum of its trigrams' vectors; a language is the sum of the unit
vectors of its training texts, less the mean of all languages. Documents are
compared with the languages by cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, is_held_out, materialize

DIM, SEED, SCALE = 1024, 20240229, 1 << 20
#: Languages that a model may have; the prototypes of so many go to the executors.
MAX_LANGS = 4096
#: Standard deviations of a chance cosine that a known language stands out by.
CHANCE = 3.0
#: Code points that are read at once; longer texts are summed piece by piece.
PIECE = 1 << 20
_CACHE_ROWS = 16384


def _letter_classes() -> np.ndarray:
    """Code point -> 0 for what is no letter, else a small number: a-z 1..26, and
    other letters folded onto 100 more classes by a multiplicative hash."""
    import sys
    import unicodedata

    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            c2 = ord(low) if len(low) == 1 else c
            out[c] = c2 - 96 if 97 <= c2 <= 122 else 27 + (c2 * 2654435761 & 0xFFFFFFFF) % 100
    return out


class Encoder:
    """Sums of trigram vectors; vectors are made when first met and kept up to a bound."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], dtype=np.int8), size=(128, dim))
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.classes, self.dim = _letter_classes(), dim
        self._at = np.full(128**3, -1, dtype=np.int32)
        self._vectors = np.zeros((_CACHE_ROWS, dim), dtype=np.int8)
        self._n = 0

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct trigrams and their counts; whether the text has a letter."""
        codes, sums, any_letter = [], [], False
        for at in range(0, len(text), PIECE):
            # one blank before and after; pieces overlap by two characters
            part = (" " if at == 0 else text[max(0, at - 2) : at]) + text[at : at + PIECE] + (" " if at + PIECE >= len(text) else "")
            c = self.classes[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
            any_letter = any_letter or bool(c.any())
            gap = c == 0
            c = c[~(gap & np.concatenate(([False], gap[:-1])))]  # one blank for any run of them
            if len(c) > 2:
                t = (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]
                u, n = np.unique(t, return_counts=True)
                codes.append(u)
                sums.append(n)
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), any_letter
        if len(codes) == 1:
            return codes[0], sums[0], any_letter
        u, back = np.unique(np.concatenate(codes), return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate(sums)).astype(np.int64), any_letter

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self._at[codes] < 0]
        if self._n + len(new) > _CACHE_ROWS:
            self._at[:], self._n = -1, 0
            new = codes
        made = self.first[new >> 14] * self.second[new >> 7 & 127] * self.third[new & 127]
        self._vectors[self._n : self._n + len(new)] = made
        self._at[new] = np.arange(self._n, self._n + len(new))
        self._n += len(new)
        return self._vectors[self._at[codes]].astype(np.float32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors (zero for a text without letters), and which have letters."""
        out, letters = np.zeros((len(texts), self.dim), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        for at in range(0, len(texts), 128):
            found = [self.counts(t or "") for t in texts[at : at + 128]]
            used = np.unique(np.concatenate([f[0] for f in found]))
            for k, f in enumerate(found):
                letters[at + k] = f[2]
            for lo in range(0, len(used), 2048):
                part = used[lo : lo + 2048]
                table = np.zeros((len(found), len(part)), dtype=np.float32)
                for k, (codes, n, _) in enumerate(found):
                    a, b = np.searchsorted(codes, part[0]), np.searchsorted(codes, part[-1], side="right")
                    table[k, np.searchsorted(part, codes[a:b])] = n[a:b]
                out[at : at + len(found)] += table @ self._rows(part)
        out[~letters] = 0
        return _unit(out), letters


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    if (dim, seed) not in _ENCODERS:
        _ENCODERS[dim, seed] = Encoder(dim, seed)
    return _ENCODERS[dim, seed]


def learn(docs: DataFrame, dim: int = DIM, seed: int = SEED, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from every row of ``docs`` that has
    text and lang and is not held out. Sums are of rounded whole numbers, so that
    no order of tasks changes them."""
    rows = docs.filter(f"text is not null and lang is not null and not {is_held_out()}").select("lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 512):
                vectors, letters = encoder(dim, seed).encode(batch.column(1).slice(at, 512).to_pylist())
                whole = np.rint(vectors * SCALE).astype(np.int64)
                own = np.array(langs[at : at + 512], dtype=object)
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + whole[(own == lang) & letters].sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], names=["lang", "k", "v"])

    summed = rows.mapInArrow(run, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    summed = materialize(docs.sparkSession, summed, "language-sums")
    names = [r[0] for r in summed.filter("k = 0").select("lang").limit(max_langs + 1).collect()]
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    names.sort()
    at, out = {x: i for i, x in enumerate(names)}, np.zeros((len(names), dim))
    for r in summed.toLocalIterator():
        out[at[r[0]], r[1]] = r[2]
    return names, _unit(out).astype(np.float32)


class Model:
    """Languages with their prototypes, less the mean of all."""

    def __init__(self, names: list[str], prototypes: np.ndarray, dim: int, seed: int):
        self.names, self.dim, self.seed = names, dim, seed
        self.mean = prototypes.mean(axis=0) if len(names) > 1 else np.zeros(dim, dtype=np.float32)
        self.centred = _unit(prototypes - self.mean) if names else prototypes

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with all languages, and which texts have letters."""
        vectors, letters = encoder(self.dim, self.seed).encode(texts)
        return _unit(vectors - self.mean) @ self.centred.T, letters

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for at in range(0, len(texts), 512):
            part = texts.slice(at, 512).to_pylist()
            if not self.names:
                langs += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            cos, letters = self.cosines(part)
            best = cos.argmax(axis=1)
            langs += [self.names[b] if ok else "und" for b, ok in zip(best, letters)]
            scores += [float(np.clip((1 + cos[i, b]) / 2, 0, 1)) if letters[i] else 0.0 for i, b in enumerate(best)]
        return langs, scores

    def known(self, texts: pa.Array, langs: frozenset | None, chance: float) -> list[bool]:
        """Whether each text is in one of ``langs`` (None: of all languages)
        beyond ``chance`` standard deviations of a chance cosine."""
        out: list[bool] = []
        wanted = np.array([langs is None or x in langs for x in self.names], dtype=bool)
        for at in range(0, len(texts), 512):
            cos, letters = self.cosines(texts.slice(at, 512).to_pylist())
            best = cos.argmax(axis=1)
            out += (letters & wanted[best] & (cos[np.arange(len(best)), best] * np.sqrt(self.dim) >= chance)).tolist()
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def train(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> Model:
    return Model(*learn(docs, dim, seed), dim, seed)


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (half of one plus
    the cosine with the best language).

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing can be learned; ties go to the alphabetically first language;
    a text repeats its result wherever it repeats; an empty table gives no rows;
    only doc_id, text and (to learn from) lang are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.withColumn("held_out", F.coalesce(F.expr(is_held_out()), F.lit(False)))


def keep_known(docs: DataFrame, langs: Iterable[str] | None = None, chance: float = CHANCE) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted language is one of
    ``langs`` (None: any that was learned) and no accident.

    The cosine of unrelated vectors has a standard deviation of 1 / sqrt(dim); a
    text whose best language is not nearer than ``chance`` of them is in no known
    language and goes, whatever its lang column says. Null texts and texts
    without a letter go too. Rows are filtered where they are read; equal texts
    share one fate; an empty table gives no rows; other columns may have any name
    and type. If no language can be learned, every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    wanted = None if langs is None else frozenset(langs)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model.names:
                keep = model.known(batch.column(at), wanted, chance)
            else:
                keep = [any(map(str.isalpha, t.as_py() or "")) for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
