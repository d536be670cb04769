"""Exact token ids of whole texts, with the ids of repeated words kept in a bounded table.

A tokenizer whose pre-tokens never cross white space (but for one leading blank) gives the same
ids for a text as for its words one by one. Words recur, so each is encoded once per worker: a slice
of texts is split and dictionary-encoded by Arrow, the table is asked for its distinct words only,
and numpy puts the ids in the words' order. A word that ends in marks splits further: between a
letter and a mark other than an apostrophe there is always a pre-token boundary. Texts with more
than single blanks and line feeds between words are split by a regular expression instead, and a
text that holds the string of an added token goes to the library whole.
"""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import workers

#: Unicode's White_Space, which is \s of the tokenizers' patterns (Python's own \s has more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space as the byte-level patterns split it.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORDS = re.compile(f"[^{SPACE}]+")
#: More than single blanks and single line feeds between words, or FIRST.
ODD = r"[ \n][ \n]|[\x00\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]\z"
#: Beyond Latin-1, where lower case may depend on more than a letter.
WIDE = r"[^\x00-\x{ff}]"
MARKS = ".,;:!?%*&$#|)]}\"-"
#: Marks the first word of a text, which no blank leads.
FIRST = "\0"
#: Bytes of text worked on at a time; bounds the memory of split words.
SLICE = 4_000_000

#: (words, what leads each of them) -> packed ids of each.
Encode = Callable[[list[str], str], list[bytes]]


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Parts of at most that many bytes, or of one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield texts.slice(at, end - at)
        at = end


class WordIds:
    """ids of texts, flat, and the number of ids of each text.

    encode: gives the packed ids of each of some words, each led by a blank or not. blank: whether a word's leading blank
    belongs to it (byte-level patterns) or white space is dropped. fold: whether the tokenizer
    lower-cases, so that Latin-1 texts may be folded before the look-up. most: words kept; when
    more are seen, the newer half goes (this changes speed, never ids). literals: the strings of
    added tokens; a text that holds one is encoded by ``whole``, as one piece.
    """

    def __init__(self, encode: Encode, dtype: str, blank: bool, fold: bool = False, most: int = 900_000, literals: tuple[str, ...] = (), whole: Callable[[str], bytes] | None = None):
        self.encode, self.dtype, self.blank, self.fold, self.most = encode, np.dtype(dtype), blank, fold, most
        self.literals, self.whole = literals, whole
        self.plain: dict[str, bytes] = {"": b""}
        #: Words after a blank; with a line feed or FIRST in front, words after that.
        self.led: dict[str, bytes] = {} if blank else self.plain

    def _learn(self, new: set[str], led: bool) -> None:
        """Put the ids of words that the table lacks into it."""
        table, lead = (self.led, " ") if led and self.blank else (self.plain, "")
        todo = [w for w in new if w.isalpha()]
        if len(todo) < len(new):
            split, tails, other = [], set(), []
            cores = set()
            for w in new:
                if w.isalpha():
                    continue
                if lead and w[:1] in ("\n", FIRST):
                    other.append(w)
                    continue
                core = w.rstrip(MARKS)
                if len(core) < len(w) and core[-1:].isalpha():
                    split.append((w, core, w[len(core) :]))
                    tails.add(split[-1][2])
                    if core not in table and core not in new:
                        cores.add(core)
                else:
                    cores.add(w)
            todo += cores
            if tails := tails.difference(self.plain):
                marks = list(tails)
                self.plain.update(zip(marks, self.encode(marks, ""), strict=True))
            if other:
                if inner := {w[1:] for w in other}.union("\n").difference(self.plain):
                    self._learn(inner, False)
                before, plain = {"\n": self.plain["\n"], FIRST: b""}, self.plain
                table.update([(w, before[w[0]] + plain[w[1:]]) for w in other])
        else:
            split = []
        table.update(zip(todo, self.encode(todo, lead), strict=True))
        plain = self.plain
        table.update([(w, table[core] + plain[tail]) for w, core, tail in split])

    def _of_words(self, lists: pa.Array, led: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for each list of words."""
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        table = self.led if led else self.plain
        found = list(map(table.get, words))
        if None in found:
            self._learn({w for w, x in zip(words, found) if x is None}, led)
            found = [table[w] if x is None else x for w, x in zip(words, found)]
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        number = size[codes]
        ends = np.concatenate([[0], np.cumsum(number)])
        small = np.int32 if ends[-1] + len(flat) < 1 << 31 else np.int64
        at = np.repeat((starts[codes] - ends[:-1]).astype(small), number)
        at += np.arange(ends[-1], dtype=small)
        return flat[at], np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.plain) + len(self.led) * self.blank > self.most:
            # Frequent words were met early: the older half stays.
            self.plain = dict(itertools.islice(self.plain.items(), len(self.plain) // 2))
            self.led = dict(itertools.islice(self.led.items(), len(self.led) // 2)) if self.blank else self.plain
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for literal in self.literals:
            special |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) & ~special
        even = ~(odd | special)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if even.any():
            some = texts.filter(pa.array(even))
            if self.blank:
                words = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(some, "\n", " \n"), ""), " ")
            else:
                words = pc.split_pattern(pc.replace_substring(self._folded(some), "\n", " "), " ")
            parts.append((np.flatnonzero(even), *self._of_words(words, True)))
        if odd.any():
            some = texts.filter(pa.array(odd))
            split = CHUNKS if self.blank else WORDS
            words = pa.array([split.findall(t) for t in (some if self.blank else self._folded(some)).to_pylist()], pa.list_(pa.string()))
            parts.append((np.flatnonzero(odd), *self._of_words(words, False)))
        if special.any():
            found = [np.frombuffer(self.whole(t), self.dtype) for t in texts.filter(pa.array(special)).to_pylist()]
            parts.append((np.flatnonzero(special), np.concatenate(found), np.array([len(x) for x in found], np.int64)))
        if len(parts) == 1:
            return parts[0][1:]
        number, pieces = np.zeros(len(texts), np.int64), [np.zeros(0, self.dtype)] * len(texts)
        for where, flat, size in parts:
            number[where] = size
            for i, piece in zip(where.tolist(), np.split(flat, np.cumsum(size)[:-1])):
                pieces[i] = piece
        return np.concatenate([np.zeros(0, self.dtype), *pieces]), number

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Texts of Latin-1 in lower case, others as they are."""
        if not self.fold:
            return texts
        return pc.if_else(pc.match_substring_regex(texts, WIDE), texts, pc.utf8_lower(texts))

    def __call__(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of slices of the texts, in order; null counts as the empty text."""
        for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            for part in slices(chunk):
                yield self._slice(part)
            pa.default_memory_pool().release_unused()


def with_end(ids: np.ndarray, number: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text's."""
    return np.insert(ids, np.cumsum(number), end_id), number + 1


def library_words(path: str, blank: bool) -> WordIds:
    """WordIds of a tokenizer file of the tokenizers library; ids as 16 bits where they fit.

    Ids are those of a plain call: strings of added tokens in a text become those tokens.
    """
    from tokenizers import Tokenizer

    plain, t = Tokenizer.from_file(path), Tokenizer.from_file(path)
    t.encode_special_tokens = True  # words are never such strings, also not once they are folded
    size = t.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    edge = np.zeros(size, bool)
    for token, i in t.get_vocab().items():
        edge[i] = token.startswith("Ġ") if blank else token.endswith("</w>")

    def encode(words: list[str], lead: str) -> list[bytes]:
        """Words of letters go through the library as one text, cut again at the words' edges."""
        out: list[bytes | None] = [None] * len(words)
        prose = [i for i, w in enumerate(words) if w.isalpha()] if lead or not blank else []
        for at in range(0, len(prose), 4096):
            part = prose[at : at + 4096]
            text = " ".join([words[i] for i in part])
            if not latin(text):
                part = [i for i in part if latin(words[i])]
                text = " ".join([words[i] for i in part])
            if not part:
                continue
            ids = np.array(t.encode_batch_fast([lead + text], add_special_tokens=False)[0].ids, kind)
            cuts = np.flatnonzero(edge[ids]) + (0 if blank else 1)
            if len(cuts) == len(part):
                raw, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
                ends = [*cuts[1:], len(raw)] if blank else cuts
                for i, a, b in zip(part, cuts if blank else [0, *cuts], ends):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, t.encode_batch_fast([lead + words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, kind).tobytes()
        return out

    # Without led words there is one table, so it may hold more.
    literals = tuple(x.content for x in plain.get_added_tokens_decoder().values())
    words = WordIds(encode, kind, blank, fold=not blank, most=800_000 if blank else 1_300_000, literals=literals, whole=lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, kind).tobytes())
    words.tokenizer = plain
    return words


def worker_words(path: str, blank: bool) -> WordIds:
    """The same table for all tasks of a Python worker, until another operator's take its place."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    # Words are no garbage: looking for some in the table, again and again, took an eighth of the time.
    gc.set_threshold(200_000, 20, 1000)
    return workers.kept((path, blank), lambda: library_words(path, blank))
