"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._encode import text_batches

#: Byte n-grams of the lower-cased words, with the blank before and behind, are hashed to 2^BITS places for each n.
GRAMS, BITS = (2, 3, 4), 15
#: First code points of script ranges, and the script. Letters of a range that isn't named are of the one before.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = sorted({name for _, name in RANGES})
N_SCRIPTS = len(SCRIPTS) + 1


def _script_table() -> np.ndarray:
    """Script (from 1; 0: within a character) by a byte and the one behind it: two bytes tell code points to 64 or better."""
    table = np.zeros(1 << 16, np.uint8)
    at = np.array([a for a, _ in RANGES])
    number = np.array([SCRIPTS.index(name) + 1 for _, name in RANGES], np.uint8)
    of = lambda points: number[np.searchsorted(at, points, "right") - 1]
    table[: 0x80 << 8] = SCRIPTS.index("latin") + 1
    for lead in range(0xC2, 0xF5):
        second = np.arange(0x80, 0xC0)
        if lead < 0xE0:
            points = (lead & 0x1F) << 6 | second & 0x3F
        elif lead < 0xF0:
            points = ((lead & 0x0F) << 6 | second & 0x3F) << 6 | 0x20  # amid the 64 of the pair
        else:
            points = ((lead & 0x07) << 6 | second & 0x3F) << 12
        table[lead << 8 | second] = of(points)
    return table


_SCRIPT = _script_table()
SIZE = len(GRAMS) << BITS
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


class Words:
    """The words of a batch of texts: runs of letters and non-ASCII bytes of the lower-cased text."""

    def __init__(self, texts: list[str | None]):
        lines = [(t or "").lower().encode("utf-8").translate(_BLANK) for t in texts]
        data = np.frombuffer(b" " + b" ".join(lines) + b"    ", np.uint8)
        blank = data == 32
        self.starts = np.nonzero(blank[:-1] & ~blank[1:])[0] + 1
        self.ends = np.nonzero(~blank[:-1] & blank[1:])[0] + 1
        bounds = 1 + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        #: First word of each text, and one behind the last.
        self.first = np.searchsorted(self.starts, bounds)
        self.data, self.blank = data, blank
        #: The script of a word: that of its first letter beyond ASCII, else of ASCII.
        self.scripts = self._scripts()

    def _scripts(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint8)
        lead = np.nonzero(self.data >= 0xC2)[0]
        out = np.full(len(self.starts), _SCRIPT[ord("a") << 8], np.uint8)
        first = np.searchsorted(lead, self.starts)
        has = first < len(lead)
        at = lead[np.minimum(first, len(lead) - 1)] if len(lead) else np.zeros(len(first), int)
        has &= at < self.ends
        out[has] = _SCRIPT[self.data[at[has]].astype(np.int64) << 8 | self.data[at[has] + 1]]
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams that touch a word and hold blanks only as their first or last byte; their first bytes."""
        size = len(self.data) - n + 1
        code = self.data[:size].astype(np.uint32)
        for k in range(1, n):
            code = code * np.uint32(0x01000193) ^ self.data[k : k + size]
        code *= np.uint32(0x9E3779B1)
        good = ~self.blank[1 : size + 1] if n > 2 else ~(self.blank[:size] & self.blank[1 : size + 1])
        for k in range(2, n - 1):
            good = good & ~self.blank[k : k + size]
        at = np.nonzero(good)[0]
        return (code[at] >> np.uint32(32 - BITS)).astype(np.int64) + ((n - GRAMS[0]) << BITS), at

    def word_of(self, at: np.ndarray) -> np.ndarray:
        """The word an n-gram belongs to: that of its first byte, or the one behind if that is a blank."""
        number = np.cumsum(np.concatenate([[0], (self.blank[:-1] & ~self.blank[1:]).astype(np.int64)])) - 1
        return number[at + self.blank[at]]


class Model:
    """Log-probabilities of n-grams, and which languages a script leaves in question."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5, least_share: float = 0.001):
        self.languages = languages
        grams = counts[:, :SIZE].reshape(len(languages), len(GRAMS), -1) + smooth
        logs = np.log(grams / grams.sum(2, keepdims=True)).reshape(len(languages), -1)
        self.table = np.ascontiguousarray((logs - logs.max(0)).T.astype(np.float32))
        scripts = counts[:, SIZE:]
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        out = share < least_share
        out[:, out.all(0)] = False
        self.barred = np.where(out, -1e4, 0).T.astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        """Of each word for each language, the best being 0."""
        n = len(words.starts)
        out = np.zeros((n, len(self.languages)), np.float32)
        for size in GRAMS:
            place, at = words.grams(size)
            own = words.word_of(at)
            if len(own):
                cuts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
                out[own[cuts]] += np.add.reduceat(self.table[place], cuts, axis=0)
        out += self.barred[words.scripts]
        return out - out.max(1, keepdims=True)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = 64) -> np.ndarray:
    """The best state of each row, a change within a text costing `penalty`. first: first row of each text, and the end.

    Texts are cut into blocks that advance together: once from every state at their start, then, when the states at the
    block borders are known, once more with the way back kept.
    """
    n, states = scores.shape
    lengths = np.diff(first)
    many = -(-lengths // block)
    block_first = np.concatenate([[0], np.cumsum(many)])
    total = int(block_first[-1])
    if not total:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(n) - np.repeat(first[:-1], lengths)
    row_block, row_at = block_first[text] + within // block, within % block
    steps = np.zeros((block, total, states), np.float32)
    steps[row_at, row_block] = scores
    alpha = np.where(np.eye(states, dtype=bool), 0, -penalty).astype(np.float32)[None].repeat(total, 0)
    for t in range(block):
        if t:
            alpha = np.maximum(alpha, alpha.max(2, keepdims=True) - penalty)
        alpha += steps[t][:, None]
    entry, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    value = np.zeros((len(lengths), states), np.float64)
    origin = np.zeros((total, states), np.int64)
    longest = np.argsort(-many, kind="stable")
    rounds = [longest[: np.searchsorted(-many[longest], -k, "left")] for k in range(int(many.max()))]
    for k, texts in enumerate(rounds):
        b = block_first[texts] + k
        way = value[texts][:, :, None] + alpha[b]
        origin[b] = way.argmax(1)
        value[texts] = way.max(1)
    state = value.argmax(1)
    for k in range(len(rounds) - 1, -1, -1):
        texts = rounds[k]
        b = block_first[texts] + k
        leave[b] = state[texts]
        entry[b] = origin[b, state[texts]]
        state[texts] = entry[b]
    alpha = np.where(np.arange(states)[None] == entry[:, None], 0, -penalty).astype(np.float32)
    before = np.zeros((block, total, states), np.uint8 if states < 256 else np.int32)
    own = np.arange(states)[None]
    for t in range(block):
        if t:
            best = alpha.argmax(1)
            top = alpha[np.arange(total), best][:, None] - penalty
            before[t] = np.where(alpha >= top, own, best[:, None])
            alpha = np.maximum(alpha, top)
        alpha += steps[t]
    path = np.zeros((block, total), np.int64)
    path[block - 1] = leave
    for t in range(block - 1, 0, -1):
        path[t - 1] = before[t][np.arange(total), path[t]]
    return path[row_at, row_block]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most_documents: int = 20_000, most_languages: int = 256) -> Model:
    """A model of the labelled rows of docs (those with a text and a language).

    More than `most_languages` different labels are an error: the table that is sent to all tasks has a row of 98,304
    numbers for each, and so many labels are no languages.

    Where there are more than `most_documents` of them, about so many are drawn by a hash of their text; whole texts
    count. n-gram counts are summed on the executors; languages x hash places reach the driver, whatever the corpus.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = min(1.0, most_documents / max(1, rows.select("lang").count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))

    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} different languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in text_batches(batches, "text"):
            by: dict[str, list[str]] = {}
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(t)
            for x, texts in by.items():
                words = Words(texts)
                own = counts.setdefault(x, np.zeros(SIZE + N_SCRIPTS, np.int64))
                for n in GRAMS:
                    own[:SIZE] += np.bincount(words.grams(n)[0], minlength=SIZE)
                own[SIZE:] += np.bincount(words.scripts, minlength=N_SCRIPTS)
        for x, own in counts.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "place", "n"])

    found = rows.mapInArrow(run, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(languages), SIZE + N_SCRIPTS))
    number = {x: i for i, x in enumerate(languages)}
    counts[[number[x] for x in found.column("lang").to_pylist()], found.column("place").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts) if languages else Model([UNKNOWN], np.zeros((1, SIZE + N_SCRIPTS)))


def label(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = 12.0) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, spans.

    spans: runs of words (start, end, lang) that the best path gives one language. lang_pred has most bytes of words
    (the first in code-point order of equals), score is their share. `und` with score 0 and no spans if the text is
    null or has no letter. Whole texts are labelled, whatever their length; repeated rows are each returned, an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.languages, object)
        for b in text_batches(batches, "text", (1 << 23) // (2 + len(own.languages))):
            texts = b.column(1).to_pylist()
            words = Words(texts)
            path = viterbi(own.scores(words), words.first, penalty)
            size = words.ends - words.starts
            langs, scores, spans = [], [], []
            for i, t in enumerate(texts):
                a, z = int(words.first[i]), int(words.first[i + 1])
                if a == z or not t or not LETTER.search(t):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    spans.append([])
                    continue
                votes = np.bincount(path[a:z], weights=size[a:z], minlength=len(names))
                best = int(votes.argmax())
                langs.append(names[best])
                scores.append(float(votes[best] / votes.sum()))
                cuts = [0, *(np.nonzero(np.diff(path[a:z]))[0] + 1).tolist(), z - a]
                spans.append([{"start": x, "end": y, "lang": names[path[a + x]]} for x, y in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
