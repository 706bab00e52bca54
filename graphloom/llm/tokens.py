"""Token ids of whole texts, equal to ``Tokenizer.encode`` of the tokenizers library, each distinct piece encoded once.

A text is cut only where the tokenizer's own pre-tokenizer is sure to cut: before a blank that follows a character
that is no white space. The ids of a text are then the ids of its pieces in a row, so distinct pieces need the library
once; a bounded table keeps their ids for the life of the Python worker."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.shared import between_tasks

#: White space before a blank, or a control character on which regular expressions disagree: such texts are encoded whole.
ODD = r"\x{2}|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |[\x{1c}-\x{1f}]"
#: Longer pieces are rare and stay in the table for one batch only.
LONG = 200
#: Begins a piece that has no blank before it; texts that hold this character are encoded whole.
BARE = "\x02"
#: Bytes that a piece takes in the table besides its characters and ids (string, number, place in the dictionary, two numbers).
ENTRY_BYTES = 180
#: Bytes of the table of pieces of a worker; beyond, it starts anew with the next batch.
TABLE_BYTES, SMALL_TABLE_BYTES = 150 << 20, 24 << 20


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """ids(texts): one array with the ids of all texts, and where each text's ids start in it."""

    odd = ODD

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer different pieces."""
        return texts

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table_bytes = table_bytes
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.entries = self.held = 0
        self.long: list[str] = []
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        n, more = self.entries, len(pieces)
        while n + more > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + more], self.counts[n : n + more] = starts + self.used, counts
        self.used += len(ids)
        self.place.update(zip(pieces, range(n, n + more), strict=True))
        self.entries += more
        self.held += ENTRY_BYTES * more + sum(map(len, pieces)) + 4 * len(ids)
        self.long += [w for w in pieces if len(w) > LONG]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.whole(pieces)
        counts = np.array([len(x) for x in found], np.int64)
        return np.concatenate(found), np.cumsum(counts) - counts, counts

    def _learn(self, inner: list[str], heads: list[str]) -> None:
        """Encode new pieces. inner: without the blank before them, in groups as one text each; heads: first pieces of texts.

        Keys of the table: an inner piece as it is, a head with a blank before it (no piece has one inside)."""
        if bare := [w for w in inner if w[:1] == BARE]:
            self._add(bare, *self._each([w[1:] for w in bare]))
            inner = [w for w in inner if w[:1] != BARE]
        plain = [w for w in inner if w and not w[-1].isspace()]
        for at in range(0, len(plain), 512):
            group = plain[at : at + 512]
            self._add(group, *self._apart([" " + w for w in group]))
        if len(plain) < len(inner):
            rest = [w for w in inner if not w or w[-1].isspace()]
            self._add(rest, *self._each([" " + w for w in rest]))
        if heads:
            self._add([" " + w for w in heads], *self._each(heads))

    def _apart(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, where each piece's ids start, how many they are."""
        return self._each(group)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd), dtype=bool) if len(texts) else np.zeros(0, bool)
        if self.held > self.table_bytes:
            self.clear()
        for w in self.long:
            del self.place[w]
        self.long = []
        even = pc.if_else(pa.array(odd), "", texts)
        split = pc.split_pattern(self.prepared(even), " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        offsets -= offsets[0]
        # the first piece of a text has no blank before it, all others do
        first = np.zeros(len(code), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        words = joined(coded.dictionary)
        rest = np.zeros(len(words), bool)
        rest[code[~first]] = True
        starting = np.unique(code[first])
        heads = [words[i] for i in starting.tolist()]
        index = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rest & (index < 0)).tolist()
        new_heads = [h for h in heads if h and " " + h not in self.place]
        if missing or new_heads:
            self._learn([words[i] for i in missing], new_heads)
            for i in missing:
                index[i] = self.place[words[i]]
        head_at = np.zeros(len(words), np.int64)
        head_at[starting] = [self.place[" " + h] if h else -1 for h in heads]
        which = np.where(first, head_at[code], index[code]) if len(code) else code
        counts = np.where(which >= 0, self.counts[which], 0)
        flat, _ = gather(self.flat, self.starts[which], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
        if not odd.any():
            return flat, ends
        places = np.flatnonzero(odd)
        apart = dict(zip(places.tolist(), self.whole([texts[int(i)].as_py() for i in places]), strict=True))
        parts = [apart[i] if i in apart else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def joined(words: pa.Array) -> list[str]:
    """The strings of an array in which none has a blank, much faster than one by one."""
    if not len(words):
        return []
    words = words.cast(pa.string())
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, " ")[0].as_py().split(" ")


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + count] in a row, and where each one starts."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - counts), counts) + np.arange(total)
    return flat[at], ends - counts


class ByteEncoder(PieceEncoder):
    """For byte-level BPE: a joined group is cut by the number of bytes that each token stands for."""

    def prepared(self, texts: pa.Array) -> pa.Array:
        """Cut, too, between an ASCII letter and a comma or full stop, and around a line's end between one of these and a letter."""
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([,.])", rf"\1 {BARE}\2")
        return pc.replace_substring_regex(texts, r"([,.])\n([A-Za-z])", f"\\1 {BARE}\n {BARE}\\2")

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        super().__init__(path, table_bytes)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 2, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)

    def _apart(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(group)
        ids = self.whole([joined])[0]
        lengths = map(len, group) if joined.isascii() else (len(p.encode()) for p in group)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(np.fromiter(lengths, np.int64, len(group)))) + 1
        starts = np.concatenate([[0], ends[:-1]])
        return ids, starts, ends - starts


class WordEncoder(PieceEncoder):
    """For BPE with word ends: white space is dropped, so a joined group is cut at a sign between its pieces."""

    MARK = "¦"
    odd = r"[\x{2}\x{1c}-\x{1f}\x{2be}\x{300}-\x{36f}]"

    def prepared(self, texts: pa.Array) -> pa.Array:
        """White space is all alike, ASCII capitals are small ones (but before a combining mark), and a comma or full stop between a letter and a blank stands for itself."""
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([,.]) ", r"\1 \2 ")

    def __init__(self, path: str, table_bytes: int = 2 * TABLE_BYTES):
        super().__init__(path, table_bytes)
        self.mark = self.whole([self.MARK])[0]

    def _apart(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined, k = f" {self.MARK}".join(group), len(self.mark)
        if joined.count(self.MARK) != len(group) - 1:
            return self._each(group)
        ids = self.whole([joined])[0]
        hit = np.ones(max(len(ids) - k + 1, 0), bool)
        for j, m in enumerate(self.mark):
            hit &= ids[j : len(ids) - k + 1 + j] == m
        ends = np.flatnonzero(hit)
        if len(ends) != len(group) - 1:
            return self._each(group)
        starts = np.concatenate([[0], ends + k])
        return ids, starts, np.concatenate([ends, [len(ids)]]) - starts


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(kind: str, path: str, table_bytes: int | None = None) -> PieceEncoder:
    """One for each worker, file and bound, kept until the worker gets a task of another kind. kind: byte or word."""
    key = kind, path, table_bytes
    if key not in _encoders:
        made = {"byte": ByteEncoder, "word": WordEncoder}[kind]
        _encoders[key] = made(path, table_bytes) if table_bytes else made(path)
    return _encoders[key]


between_tasks(_encoders.clear)
