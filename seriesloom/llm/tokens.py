"""Exact and fast token ids of whole columns of text, for use inside Arrow functions.

A text is cut at single spaces, where none of the three public tokenizers can merge across. The pieces of a
batch are dictionary-encoded by Arrow, so that each different piece is looked up once; pieces not met before go
to the tokenizer's library. Texts in which a cut could change the ids (runs of white space, special strings) go
to the library whole. The ids are those of the library on the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once; a longer text is cut further at safe places.
CHUNK_BYTES = 2 << 20
#: Pieces whose ids a Python worker remembers; beyond it, only those of the last chunk stay.
MEMO_PIECES = 300_000
#: Letters and signs for which a piece's ids are those of its letters followed by those of its signs.
LETTERS, SIGNS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"


class PieceEncoder:
    """Ids of texts by pieces. Subclasses say which texts are hard and ask the library for ids.

    The memory of pieces is an Arrow array of strings and one array of ids, not Python objects: small, and
    looked up for a chunk at a time.
    """

    #: RE2 pattern of texts that must not be cut; the empty pattern matches every text.
    hard = ""
    #: RE2 pattern with groups s and p: pieces whose ids are those of s followed by those of p.
    atoms = ""
    #: Whether a piece after a space has other ids than the same piece at a text's start.
    leading_space = False
    #: Whether letter case makes no difference.
    lower = False

    def __init__(self) -> None:
        self.keys, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        raise NotImplementedError

    def pieces(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pieces one after another, and the number of each."""
        return _flat(self.library(keys.to_pylist()))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        return pc.split_pattern(texts, " ")

    def lookup(self, keys: pa.Array) -> np.ndarray:
        """Places of the pieces in the memory, which takes up those not met before."""
        if len(self.keys) > MEMO_PIECES:
            own = np.flatnonzero(np.asarray(pc.is_in(self.keys, value_set=keys)))
            self.ids, size = gather(self.ids, self.ends[:-1], np.diff(self.ends), own)
            self.keys, self.ends = self.keys.take(pa.array(own)), np.concatenate(([0], np.cumsum(size)))
        at = pc.index_in(keys, value_set=self.keys)
        new = at.is_null()
        if not at.null_count:
            return np.asarray(at, np.int64)
        missing = keys.filter(new)
        unknown = missing.unique()
        out = np.asarray(pc.fill_null(at, -1), np.int64).copy()
        out[np.asarray(new)] = np.asarray(pc.index_in(missing, value_set=unknown), np.int64) + len(self.keys)
        ids, size = self.pieces(unknown)
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))
        self.keys = pa.concat_arrays([self.keys, unknown])
        return out

    def units(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each different piece, one after another, and the number of each."""
        if not self.atoms:
            at = self.lookup(keys)
            return gather(self.ids, self.ends[at], np.diff(self.ends)[at], np.arange(len(at)))
        split = pc.extract_regex(keys, self.atoms)
        known = np.asarray(split.is_valid().to_numpy(zero_copy_only=False), bool)
        stems, tails = (pc.struct_field(split, k).filter(pa.array(known)) for k in ("s", "p"))
        stems = (pc.utf8_lower(stems) if self.lower else stems).dictionary_encode()
        tails = tails.dictionary_encode()
        others = keys.filter(pa.array(~known))
        at = self.lookup(pa.concat_arrays([stems.dictionary, tails.dictionary, others]))
        begin, size = np.append(self.ends[at], 0), np.append(np.diff(self.ends)[at], 0)  # the last one is empty
        place = np.full((len(keys), 2), len(at), np.int32)
        place[known, 0] = np.asarray(stems.indices)
        place[known, 1] = np.asarray(tails.indices) + len(stems.dictionary)
        place[~known, 0] = np.arange(len(others)) + len(stems.dictionary) + len(tails.dictionary)
        ids, each = gather(self.ids, begin, size, place.ravel())
        return ids, each.reshape(-1, 2).sum(axis=1)

    def ragged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of the different pieces, the piece number at each place, the first place of each text."""
        lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = np.asarray(lists.offsets)[: len(lists) + 1].astype(np.int64)
        offsets -= offsets[0]
        index, keys = np.array(coded.indices), coded.dictionary
        if self.leading_space:
            starts = offsets[:-1]
            begin, place = np.unique(index[starts], return_inverse=True)
            index[starts] = len(keys) + place
            spaced = pc.if_else(pc.starts_with(keys, "\n"), keys, pc.binary_join_element_wise(" ", keys, ""))
            keys = pa.concat_arrays([spaced, keys.take(pa.array(begin))])
        return *self.units(keys), index, offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids begin (one entry more)."""
        texts = _strings(texts)
        n = len(texts)
        lens, parts = np.zeros(n, np.int64), [None] * n
        for rows, easy in self._split(texts):
            if not easy:
                for i, got in zip(rows, self.library(texts.take(pa.array(rows)).to_pylist()), strict=True):
                    parts[i] = got
                continue
            flat, size, index, offsets = self.ragged(texts.take(pa.array(rows)))
            ids, each = gather(flat, np.cumsum(size) - size, size, index)
            ends = np.concatenate(([0], np.cumsum(each)))[offsets]
            if len(rows) == n:
                return ids, ends
            for k, i in enumerate(rows):
                parts[i] = ids[ends[k] : ends[k + 1]]
        lens = np.fromiter(map(len, parts), np.int64, n)
        return (np.concatenate(parts) if n else np.zeros(0, "<u4")), np.concatenate(([0], np.cumsum(lens)))

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        texts = _strings(texts)
        out = np.zeros(len(texts), np.int64)
        for rows, easy in self._split(texts):
            if not easy:
                out[rows] = [len(x) for x in self.library(texts.take(pa.array(rows)).to_pylist())]
                continue
            _, size, index, offsets = self.ragged(texts.take(pa.array(rows)))
            out[rows] = np.diff(np.concatenate(([0], np.cumsum(size[index])))[offsets])
        return out

    def _split(self, texts: pa.Array):
        """Row numbers of the texts that can be cut, in chunks of a bounded size, then of the others."""
        if not len(texts):
            return
        hard = np.asarray(pc.match_substring_regex(texts, self.hard).to_numpy(zero_copy_only=False), bool)
        size = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
        for easy in (True, False):
            rows = np.flatnonzero(hard != easy)
            part = (np.cumsum(size[rows]) - size[rows]) // CHUNK_BYTES
            for p in np.unique(part):
                yield rows[part == p], easy


def _strings(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return (np.concatenate(rows) if rows else np.zeros(0, "<u4")), size


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` (given by first places and sizes) in the order of `index`, one after another, and their sizes."""
    begin, each = begin[index], size[index]
    shift = begin - (np.cumsum(each) - each)
    where = np.repeat(shift.astype(np.int32), each)  # a chunk and the memory have far fewer than 2**31 ids
    where += np.arange(len(where), dtype=np.int32)
    return flat[where], each


def with_ends(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids (as encode() gives them) with `end_id` after each text, and the new offsets."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about CHUNK_BYTES of column `text`, so that few calls meet all pieces."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def _u4(ids: list[int]) -> np.ndarray:
    return np.asarray(ids, "<u4")


def _boundaries(widths: np.ndarray, cuts: np.ndarray) -> np.ndarray | None:
    """How many tokens (of the given widths in bytes) lie before each cut; None if a token reaches across one."""
    ends = np.concatenate(([0], np.cumsum(widths)))
    at = np.searchsorted(ends, cuts)
    return at if len(at) and at[-1] < len(ends) and ends[-1] == cuts[-1] and np.array_equal(ends[at], cuts) else None


class _JsonEncoder(PieceEncoder):
    """A vocabulary of the tokenizers library. This class alone gives every text to the library whole."""

    #: RE2 pattern of pieces that the library may be given many at a time.
    plain = "^x^"

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def library(self, texts):
        return [_u4(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _widths(self, suffix: str) -> np.ndarray:
        """By id, the bytes of a token; each character of its name stands for one byte."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token.removesuffix(suffix))
        return out

    def together(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain pieces by one call on all of them, told apart by the tokens' bytes; None if that fails."""
        raise NotImplementedError

    def pieces(self, keys):
        plain = pc.match_substring_regex(keys, self.plain)
        easy, odd = keys.filter(plain), keys.filter(pc.invert(plain))
        got = (self.together(easy) or _flat(self.library(easy.to_pylist()))) if len(easy) else _flat([])
        if not len(odd):
            return got
        rest = _flat(self.library(odd.to_pylist()))
        size = np.concatenate((got[1], rest[1]))
        plain = np.asarray(plain)
        place = np.empty(len(keys), np.int64)
        place[plain], place[~plain] = np.arange(len(easy)), np.arange(len(odd)) + len(easy)
        return gather(np.concatenate((got[0], rest[0])), np.cumsum(size) - size, size, place)


class ByteBpe(_JsonEncoder):
    """Byte-level BPE: a space belongs to the word after it; runs of white space stay together.

    A line break between a sign or letter and a letter is a token of its own: texts are cut before it as well.
    """

    hard = r"<\||[ ][\s\p{Z}\x0b\x1c-\x1f\x{85}]"
    atoms = f"^(?P<s>[ \n]?{LETTERS})(?P<p>{SIGNS})$"
    leading_space = True
    plain = "^(?:[ \n]?[!-~À-ÖØ-öø-ÿ]+|)$"

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.width = self._widths("")
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def cut(self, texts):
        return pc.split_pattern(pc.replace_substring_regex(texts, "([!-~À-ÖØ-öø-ÿ])\n([A-Za-zÀ-ÖØ-öø-ÿ])", "\\1 \n\\2"), " ")

    def together(self, keys):
        """Pieces with a space or line break in front follow one another as in a text; others get a line break."""
        bare = np.asarray(pc.invert(pc.match_substring_regex(keys, "^[ \n]")))
        led = pc.if_else(pa.array(bare), pc.binary_join_element_wise("\n", keys, ""), keys)
        ids = _u4(self.tokenizer.encode_batch_fast(["".join(led.to_pylist())], add_special_tokens=False)[0].ids)
        at = _boundaries(self.width[ids], np.cumsum(np.asarray(pc.binary_length(led), np.int64)))
        if at is None or len(self.line_break) != 1:
            return None
        first = np.concatenate(([0], at[:-1]))[bare]
        if not (ids[first] == self.line_break[0]).all():
            return None
        return np.delete(ids, first), np.diff(at, prepend=0) - bare


class WordBpe(_JsonEncoder):
    """BPE over lower-cased words with word ends; white space only separates."""

    hard = r"<\|"
    atoms = f"^(?P<s>{LETTERS})(?P<p>{SIGNS})$"
    lower = True
    plain = "^[!-~À-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.width = self._widths("</w>")

    def cut(self, texts):
        return pc.ascii_split_whitespace(texts)

    def together(self, keys):
        ids = _u4(self.tokenizer.encode_batch_fast([" ".join(keys.to_pylist())], add_special_tokens=False)[0].ids)
        at = _boundaries(self.width[ids], np.cumsum(np.asarray(pc.binary_length(keys), np.int64)))
        return None if at is None else (ids, np.diff(at, prepend=0))


class PieceBpe(PieceEncoder):
    """Sentencepiece BPE: each word carries its space in front, the first one a space that the library adds."""

    hard = r"^ | $|  |\x{2581}|\x00"

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        space = "▁"
        names = (self.processor.id_to_piece(i) for i in range(len(self.processor)))
        if any(space in p.lstrip(space) for p in names):  # a merge could then cross a cut
            self.hard = ""

    def library(self, texts):
        return [_u4(x) for x in self.processor.encode(texts, num_threads=1)]


def _kind(path: str) -> type[_JsonEncoder]:
    """Which rules hold for a vocabulary file of the tokenizers library, by its own normalizer and pre-tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, normal, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix"):
        return _JsonEncoder
    suffix = model.get("end_of_word_suffix")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal and not suffix:
        return ByteBpe
    if suffix == "</w>" and any(n.get("type") == "Lowercase" for n in normal.get("normalizers", [])) and any(s.get("type") == "Split" and s.get("invert") for s in before.get("pretokenizers", [])):
        return WordBpe
    return _JsonEncoder


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The encoder of a vocabulary file; a Python worker loads it once."""
    return PieceBpe(path) if path.endswith(".model") else _kind(path)(path)


def cut_long(text: str, limit: int, keep_space: bool) -> list[str]:
    """`text` in parts of about `limit` characters, cut at single spaces between other characters."""
    parts, begin = [], 0
    while len(text) - begin > limit:
        at = text.rfind(" ", begin + 1, begin + limit)
        while at > begin + 1 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace()):
            at = text.rfind(" ", begin + 1, at)
        if at <= begin + 1:
            break
        parts.append(text[begin:at])
        begin = at if keep_space else at + 1
    return [*parts, text[begin:]]
