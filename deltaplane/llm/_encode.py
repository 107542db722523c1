"""Token ids of whole texts by the tokenizers library, each distinct chunk of a batch looked up once."""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of bytes: letters, digits, ASCII white space, other printable ASCII, the apostrophe, anything else.
LETTER, DIGIT, BLANK, MARK, QUOTE, OTHER = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = MARK
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[39] = DIGIT, LETTER, LETTER, QUOTE
CLASS[[32, 9, 10, 11, 12, 13]] = BLANK
#: White space beyond ASCII, and control characters that some rules call white space.
ODD_BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _cuts(digits: bool) -> np.ndarray:
    """Whether the rules always cut between a byte of one class and the next: [before, behind]; digits: between any two."""
    out = np.zeros((6, 6), bool)
    for a in (LETTER, DIGIT, MARK, QUOTE):
        for b in (LETTER, DIGIT, MARK, QUOTE):
            # Marks and apostrophes stay together; an apostrophe may open a contraction.
            out[a, b] = a != b and not {a, b} <= {MARK, QUOTE} and (a, b) != (QUOTE, LETTER)
    out[DIGIT, DIGIT] = digits
    return out


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    The texts of a batch are cut, all at once, where the tokenizer's own rules always cut: between ASCII letters, digits
    and marks, and at runs of ASCII white space. Each distinct chunk is looked up once for a batch; those not known go
    to the library, whose normaliser, pre-tokenizer and model make the ids. Texts with a special token in them, or with
    white space beyond ASCII, stay whole. Known chunks are kept up to about `most` bytes; then the memory starts anew.
    """

    def __init__(self, path: str, most: int = 1 << 26, longest: int = 64):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.specials = [t["content"] for t in rules["added_tokens"]]
        kinds = {x.get("type") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])}
        #: The rules drop white space and case, and part digits.
        self.drops = "Split" in kinds and bool(rules["normalizer"])
        if not self.drops and (rules["normalizer"] or (rules["pre_tokenizer"] or {}).get("type") != "ByteLevel"):
            raise ValueError(f"no cutting rule for the tokenizer in {path}")
        self.cuts = _cuts(self.drops).ravel()
        self.most, self.longest, self.model = most, longest, self.tokenizer.model
        #: The byte alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.held = array("I"), array("q", [0]), 0

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def ids(self, chunk: str) -> list[int]:
        """Of any chunk that stands by itself."""
        t, out = self.tokenizer, []
        if self._special(chunk):
            return t.encode(chunk, add_special_tokens=False).ids
        lead, word = (" ", chunk[1:]) if chunk[:1] == " " else ("", chunk)
        if word.isalpha() and not (lead and self.drops) and (not self.drops or "Σ" not in word and unicodedata.is_normalized("NFC", word)):
            # Letters are one piece in any of the rules; the library lower-cases by character, so a final sigma is like any other.
            word = word.lower() if self.drops else word
            if word.isalpha():
                return [x.id for x in self.model.tokenize((lead + word).encode().decode("latin-1").translate(self.alphabet))]
        if t.normalizer is not None:
            chunk = t.normalizer.normalize_str(chunk)
        for piece, _ in t.pre_tokenizer.pre_tokenize_str(chunk):
            out += [x.id for x in self.model.tokenize(piece)]
        return out

    def _add(self, chunks: list[str], plain: list[bool]) -> list[int]:
        """Numbers of new chunks; plain ones are a single piece of ASCII or white space alone."""
        out, tokenize, flat, starts, drops = [], self.model.tokenize, self.flat, self.starts, self.drops
        space = self.alphabet[32]
        for chunk, simple in zip(chunks, plain, strict=True):
            if not simple:
                flat.extend(self.ids(chunk))
            elif drops or chunk.isalpha():
                flat.extend([x.id for x in tokenize(chunk)])
            elif chunk[0] == " " and chunk[1:].isalpha():
                flat.extend([x.id for x in tokenize(space + chunk[1:])])
            else:
                flat.extend([x.id for x in tokenize(chunk.translate(self.alphabet))])
            out.append(len(starts) - 1)
            starts.append(len(flat))
            if len(chunk) <= self.longest:
                self.known[chunk] = out[-1]
                self.held += 160 + len(chunk)
        return out

    def _chunks(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks of the texts, and how many each text has."""
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset).astype(np.int64)
        data = column.buffers()[2]
        x = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        whole = pc.match_substring_regex(column, ODD_BLANKS)
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(column, s))
        whole = whole.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        kind = CLASS[x]
        begin = np.zeros(len(x) + 1, bool)
        blank = kind == BLANK
        begin[1:-1] = self.cuts[kind[:-1] * np.uint8(6) + kind[1:]]
        texts = offsets[:-1][lengths > 0]
        first = np.zeros(len(x) + 1, bool)
        first[offsets] = True
        if self.drops:
            keep = ~blank
            begin[1:-1] |= blank[:-1] & keep[1:]
            begin[texts] = True
            if whole.any():
                inside = np.repeat(whole, lengths)
                keep |= inside
                begin[:-1] &= ~inside
                begin[texts] = True
            # A text or chunk that opens with blanks begins with its first byte that is kept.
            lower = np.where((x >= 65) & (x <= 90), x | 32, x) if not whole.any() else np.where((x >= 65) & (x <= 90) & ~inside, x | 32, x)
            before = np.concatenate([[0], np.cumsum(keep)])
            x, offsets = lower[keep], before[offsets]
            moved = np.zeros(len(x) + 1, bool)
            moved[before[np.nonzero(begin)[0]]] = True
            at = np.nonzero(moved[:-1])[0]
        else:
            after = np.concatenate([blank[1:], [True]])  # a blank or the end of all texts follows
            after[offsets[1:][lengths > 0] - 1] = True
            run = np.concatenate([[False], blank[:-1]]) & ~first[:-1]
            begin[:-1] |= blank & ~run | blank & run & ~after
            begin[1:-1] |= blank[:-1] & ~blank[1:] & (x[:-1] != 32)
            if whole.any():
                begin[:-1] &= ~np.repeat(whole, lengths)
            begin[texts] = True
            at = np.nonzero(begin[:-1])[0]
        counts = np.diff(np.searchsorted(at, offsets))
        bounds = np.concatenate([at, [len(x)]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(x))), counts

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind another (uint32) and how many each text has; for a batch of bounded size."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        if self.held > self.most:
            self._clear()
        chunks, counts = self._chunks(column)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary
        found = distinct.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.known.get, found))
        new = [i for i, k in enumerate(number) if k is None]
        if new:
            ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, 4 * distinct.offset)
            kind = CLASS[np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
            odd = np.concatenate([[0], np.cumsum(kind >= QUOTE)])
            # A chunk that stayed whole may hold several classes; those have odd blanks or specials, so that they count as odd too.
            plain = odd[ends[1:] - ends[0]] == odd[ends[:-1] - ends[0]]
            if self.specials:
                for s in self.specials:
                    plain &= ~pc.match_substring(distinct, s).to_numpy(zero_copy_only=False)
            for i, k in zip(new, self._add([found[i] for i in new], plain[new].tolist()), strict=True):
                number[i] = k
        starts = np.frombuffer(self.starts, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        k = np.array(number, np.int64)
        first, size = starts[k], starts[k + 1] - starts[k]
        at = coded.indices.to_numpy()
        lengths = size[at]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(first[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        del starts, flat  # their buffers can't grow while they are viewed
        return ids, np.diff(bounds)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what is remembered outlives a task."""
    return Encoder(path)


def text_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut to about so many bytes of text, one row at least."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        sizes = np.cumsum(np.array(pc.binary_length(column).fill_null(0)).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
            yield b.slice(at, to - at)
            at = to
