"""Language ID for mixed-language text.

Words are runs of letters. The script of a word (by code point ranges) narrows the
languages it may belong to; letter trigrams score it under each of those. Viterbi with
a penalty for switching the language then labels every word of the text, so a passage
in another language becomes a span of its own and a stray foreign word does not.

Words whose best language leads by more than two penalties keep that label on any best
path (leaving and returning costs two penalties), so the text falls apart into short
segments between them; all segments of a block advance together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import fit_share, mixed, per_block, spans_of

BUCKETS = 1 << 16
#: Rows that the model is fitted on at most, drawn by a hash of doc_id.
FIT_ROWS = 20_000
SWITCH = 6.0
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

# First code points of Unicode script blocks, in order; the names are only labels.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPT_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter (0: not a letter), its script, and whether it is a letter."""
    n = 0x110000
    lower = np.zeros(n, np.uint32)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    firsts = np.array([a for a, _ in SCRIPTS])
    names = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], np.uint8)
    return lower, names[np.searchsorted(firsts, np.arange(n), side="right") - 1], lower > 0


@dataclass
class Words:
    """The words of a block: letters, script, places, and per text the place of its first word."""

    grams: np.ndarray  # bucket of the trigram around each letter of the block, word by word
    at: np.ndarray  # first letter of each word in ``grams``
    script: np.ndarray
    starts: np.ndarray  # code points from the start of the block
    ends: np.ndarray
    first: np.ndarray  # per text, and one more
    text_at: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Words of the texts; neither the case nor what stands between words matters."""
    lower, script, letter = _letters()
    cps = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    is_letter = letter[cps]
    x = np.concatenate([[0], lower[cps], [0]]).astype(np.uint64)
    starts, ends = spans_of(is_letter)
    inside = np.flatnonzero(is_letter)
    gram = mixed(x[inside] << np.uint64(42) | x[inside + 1] << np.uint64(21) | x[inside + 2]) & np.uint64(BUCKETS - 1)
    text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return Words(gram.astype(np.int64), at, script[cps[starts]], starts, ends, np.searchsorted(starts, text_at), text_at)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, languages): log share of the trigram
    allowed: np.ndarray  # (scripts, languages)
    common: int  # the language with most letters, for words that no language can have

    def scores(self, w: Words) -> np.ndarray:
        """Log likelihood of each word under each language; languages without its script stand far below."""
        if not len(w.at):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.stack([np.add.reduceat(self.weights[:, k][w.grams], w.at) for k in range(len(self.langs))], axis=1)
        allowed = self.allowed[w.script]
        some = allowed.any(axis=1)
        s[~some] = 0
        s[some[:, None] & ~allowed] = s.min() - 1000 if len(s) else 0
        return s


def _counts(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    """Trigram counts by language; scripts follow as buckets from BUCKETS on."""
    out = []
    for lang, own in rows.reset_index(drop=True).groupby("lang"):
        w = words_of([texts[i] for i in own.index])
        c = np.bincount(w.grams, minlength=BUCKETS)
        s = np.bincount(w.script, weights=w.ends - w.starts, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        c = np.concatenate([c, s])
        at = np.flatnonzero(c)
        out.append(pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "bucket": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by the checksum of its id; a document without id never trains and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from text and lang of labelled documents that are not held out; None where there is none.

    The driver receives at most one count per language and bucket.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    drawn = fit_share(known, "doc_id", rows, 31).select("lang", "text")
    counted = drawn.mapInPandas(per_block(_counts), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    langs = sorted(counted["lang"].unique())
    grid = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    grid[[langs.index(x) for x in counted["lang"]], counted["bucket"]] = counted["n"]
    grams, scripts = grid[:, :BUCKETS], grid[:, BUCKETS:]
    weights = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(weights.T.astype(np.float32)), allowed.T, int(scripts.sum(axis=1).argmax()))


def viterbi(s: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language per word, where a change between neighbours of one text costs ``switch``.

    ``first``: place of every text's first word, and the number of words. Of equal
    paths the one that stays longer in the lower language wins.
    """
    n, k = s.shape
    label = np.zeros(n, np.int64)
    if k < 2 or not n:
        return label
    two = np.partition(s, k - 2, axis=1)
    sure = two[:, k - 1] - two[:, k - 2] > 2 * switch
    label[sure] = s[sure].argmax(axis=1)
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    # segments: runs of unsure words, cut where a text begins
    start = np.flatnonzero(~sure & (opens[:n] | np.concatenate([[True], sure[:-1]])))
    end = np.flatnonzero(~sure & (opens[1:] | np.concatenate([sure[1:], [True]]))) + 1
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    length = end - start
    before = np.where(opens[start], -1, label[np.maximum(start - 1, 0)])
    after = np.where(opens[end], -1, label[np.minimum(end, n - 1)])
    ids = np.arange(k)
    v = s[start] - switch * ((before[:, None] >= 0) & (before[:, None] != ids))
    came = np.zeros((n, k), np.uint8 if k < 256 else np.int32)
    for t in range(1, int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -t, side="left"))  # segments longer than t
        prev = v[:m]
        best = prev.argmax(axis=1)
        top = prev[np.arange(m), best][:, None] - switch
        stay = prev >= top
        came[start[:m] + t] = np.where(stay, ids, best[:, None])
        v[:m] = np.where(stay, prev, top) + s[start[:m] + t]
    v = v - switch * ((after[:, None] >= 0) & (after[:, None] != ids))
    state = v.argmax(axis=1)
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        m = int(np.searchsorted(-length, -t, side="left"))
        at = start[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = came[at, state[:m]]
    return label


OUT = "doc_id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def _labels(model: Model | None):
    def build(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        out = []
        w = words_of(texts)
        label = viterbi(model.scores(w), w.first) if model else None
        size = w.ends - w.starts
        for i, doc in enumerate(rows["doc_id"]):
            a, b = w.first[i], w.first[i + 1]
            if a == b or not model:
                out.append((doc, UNDETERMINED, 0.0, []))
                continue
            share = np.bincount(label[a:b], weights=size[a:b], minlength=len(model.langs))
            none = not model.allowed[w.script[a:b]].any()
            best = model.common if none else int(share.argmax())
            cut = np.concatenate([[a], np.flatnonzero(np.diff(label[a:b])) + a + 1, [b]])
            spans = [{"start": int(w.starts[x] - w.text_at[i]), "end": int(w.ends[y - 1] - w.text_at[i]), "lang": model.langs[best if none else label[x]]} for x, y in zip(cut[:-1], cut[1:])]
            out.append((doc, model.langs[best], 1 / len(model.langs) if none else float(share[best] / share.sum()), spans))
        return pd.DataFrame(out, columns=["doc_id", "lang_pred", "score", "spans"]).astype({"doc_id": "Int64"})

    return build


def kept(model: Model | None, least: float):
    """mapInPandas over whole rows: those with letters, and at least that share of them in one language.

    Without a model, every text with letters stays.
    """
    label = _labels(model)

    def build(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        if model is None:
            return rows[[any(c.isalpha() for c in t) for t in texts]]
        found = label(rows, texts)
        return rows[((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least)).to_numpy()]

    return per_block(build)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of every document and the spans (code points) of its languages.

    ``score`` is the share of letters in spans of the language. Null texts and texts
    without letters, and all texts where there is no model, are ``und`` with score 0.
    Text in scripts that no language uses gets the language with most training letters
    at the score of a guess. Only the text is read.
    """
    return docs.select("doc_id", "text").mapInPandas(per_block(_labels(model)), OUT)
