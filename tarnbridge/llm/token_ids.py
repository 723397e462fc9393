"""Token ids by the tokenizers library, memoised by unit.

A unit is a stretch of text that the tokenizer treats the same wherever it stands, so a text's ids are its units'
ids in a row. Natural text repeats few units very often; the library encodes each distinct one once. Arrow splits a
batch of texts, numbers its distinct units and looks them up, and numpy puts the ids in order: Python handles only units that
are not known. Of these, plain words are encoded many at a time, the others one by one. Texts with special-token strings
or unusual white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that keep a text out of the unit path: white space on which regular expression engines may disagree, and our own marks.
ODD = [1, 2, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
#: Those, or the start of a special token. This and the patterns below without compile are in RE2's syntax.
UNUSUAL = "[" + "".join(rf"\x{{{c:X}}}" for c in ODD) + r"]|<\|"
#: Where white space stands in runs, a byte-level tokenizer's units need a look at what follows.
RUNS = r"[ \t\n\r\x0b\x0c][ \t\n\r\x0b\x0c]"
#: A byte-level tokenizer joins one blank to the word after it.
BYTE_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Latin letters that are the same under NFC.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Between a word and punctuation both kinds of tokenizers split.
MARKS = rf"([{LETTERS}])([.,;:!?#*$%&|]+)"
#: Plain words: a byte-level tokenizer's with the blank before them.
WORDS = {"byte": rf"^ [{LETTERS}]+$", "word": rf"^[{LETTERS}]+$"}
#: Between units, and before the number of a text that goes to the library whole.
BREAK, WHOLE = "\x02", "\x01"
#: Units that are remembered and their ids; bytes of text that are encoded at once; words in one call of the library.
MOST_UNITS, MOST_IDS, SLICE_BYTES, WORDS_AT_ONCE = 400_000, 3_000_000, 4_000_000, 500


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts have about `most` bytes; a longer text is a part of its own. No row, no part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


class UnitEncoder:
    """Ids of batches of texts. kind says how the tokenizer of the file splits: 'byte' or 'word'; another one is an error.

    Memory is bounded: what is remembered is dropped when there are more than MOST_UNITS units or MOST_IDS ids.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in WORDS:
            raise ValueError(f"no kind {kind!r}: one of {', '.join(WORDS)}")
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        # a plain word's first id in a byte-level vocabulary, its last in one with word ends
        at_edge = [i for word, i in self.tokenizer.get_vocab().items() if (word.startswith("Ġ") if kind == "byte" else word.endswith("</w>"))]
        self.edge = np.zeros(max(at_edge, default=0) + 1, bool)
        self.edge[at_edge] = True
        self.n_whole = 0
        self._forget()
        self._check()

    def _check(self) -> None:
        """A few texts on which tokenizers of another kind than the stated one differ."""
        probe = ["Plain words, and  two blanks\nnext\tLine's 12 ends. ", " Éa's b!? c", "don't (x) y--z #5"]
        ids, sizes = self.encode(pa.array(probe))
        if [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] != self.whole(probe):
            raise ValueError(f"the tokenizer does not split texts as kind {self.kind!r} does")

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.starts, self.sizes, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of each word's) of plain words, many in one text. None if their edges do not show."""
        joint = ("" if self.kind == "byte" else " ").join
        parts = self.whole([joint(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
        ids = np.concatenate([np.array(x, np.uint32) for x in parts])
        if ids.max() >= len(self.edge):
            self.edge = np.concatenate([self.edge, np.zeros(ids.max() + 1 - len(self.edge), bool)])
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return None
        return ids, np.diff(edges, append=len(ids)) if self.kind == "byte" else np.diff(edges, prepend=-1)

    def _place(self, units: pa.Array, since: int) -> np.ndarray:
        """Where the known units from number since on have these; -1: nowhere."""
        return pc.fill_null(pc.index_in(units, value_set=self.known.slice(since)), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _learn(self, units: pa.Array, whole: dict[str, list[int]]) -> None:
        """Remembers the ids of units that are not known."""
        plain = pc.match_substring_regex(units, WORDS[self.kind])
        words = units.filter(plain)
        found = self._words(words.to_pylist()) if len(words) else None
        if found is None:
            words, found = units.slice(0, 0), (np.empty(0, np.uint32), np.empty(0, np.int64))
        others = units.filter(pc.invert(plain)) if len(words) else units
        listed = others.to_pylist()
        encoded = [whole.get(u, x) for u, x in zip(listed, self.whole(listed), strict=True)]
        sizes = np.concatenate([found[1], np.array([len(x) for x in encoded], np.int64)])
        self.known = pa.concat_arrays([self.known, words, others])
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, found[0], *[np.array(x, np.uint32) for x in encoded]])

    def _units(self, texts: pa.Array) -> tuple[pa.Array, dict[str, list[int]]]:
        """Lists of units, and the ids of those that stand for whole texts."""
        if self.kind == "byte":
            marked = pc.replace_substring(pc.replace_substring(texts, " ", BREAK + " "), "\n", BREAK + "\n" + BREAK)
            runs = np.flatnonzero(pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False))
        else:
            marked, runs = texts, np.empty(0, int)
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False))
        names = [f"{WHOLE}{self.n_whole + i}" for i in range(len(odd))]
        self.n_whole += len(odd)
        changed = {int(i): BREAK.join(BYTE_UNITS(texts[int(i)].as_py())) for i in runs} | dict(zip(odd.tolist(), names, strict=True))
        whole = dict(zip(names, self.whole([texts[i].as_py() for i in odd.tolist()]), strict=True))
        if changed:
            mask = np.zeros(len(texts), bool)
            mask[list(changed)] = True
            marked = pc.replace_with_mask(marked, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], marked.type))
        between = BREAK if self.kind == "byte" else " "
        marked = pc.replace_substring_regex(marked, MARKS, rf"\1{between}\2")
        return pc.split_pattern(marked, BREAK) if self.kind == "byte" else pc.ascii_split_whitespace(marked), whole

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units in a row, and where each text's units end."""
        if len(self.known) > MOST_UNITS or len(self.pool) > MOST_IDS:
            self._forget()
        lists, whole = self._units(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        found, n_known = self._place(coded.dictionary, 0), len(self.known)
        if (new := found < 0).any():
            unknown = coded.dictionary.filter(pa.array(new))
            self._learn(unknown, whole)
            found[new] = n_known + self._place(unknown, n_known)
        out = found[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        return out, ends

    def _counted(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each unit, and of each text."""
        each = self.sizes[numbers]
        upto = np.concatenate([[0], np.cumsum(each)])[ends]
        return each, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row as little-endian unsigned 32-bit integers, the number of each text's). A null text is empty."""
        numbers, ends = self._numbered(texts)
        each, sizes = self._counted(numbers, ends)
        places = np.repeat(self.starts[numbers] - (np.cumsum(each) - each), each)
        places += np.arange(len(places))
        return self.pool[places].astype("<u4", copy=False), sizes

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of each text's ids."""
        return self._counted(*self._numbered(texts))[1]

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode(texts) with end_id behind each text."""
        ids, sizes = self.encode(texts)
        return np.insert(ids, np.cumsum(sizes), end_id).astype("<u4", copy=False), sizes + 1


_by_path: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, kind: str) -> UnitEncoder:
    """One for each worker process and vocabulary file."""
    if (path, kind) not in _by_path:
        _by_path[path, kind] = UnitEncoder(path, kind)
    return _by_path[path, kind]
