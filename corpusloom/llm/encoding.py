"""Whole-text token ids from a tokenizer file, with each distinct word encoded once.

Both kinds of file used here never join what stands on the two sides of a single space between two visible characters:
the byte-level one starts a new piece at that space and keeps it as the piece's first byte, the word-level one drops
white space. So a text is cut at its spaces, each distinct piece goes through the tokenizers library once, and the ids of
a text are its pieces' ids end to end. For byte-level files a piece that is empty or has white space at an end is
not such a place, and the whole text then goes through the library as it is. So does a text with the string of an added token.

Pieces that are letters only, or letters and closing marks, make up nearly all of a text. Both files split exactly
between the letters and the marks, so their letters are encoded many at a time, as one text that the same model reads with
a plain splitter at zero bytes in place of the file's pattern.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII marks: neither letters, numbers nor white space; without the apostrophe, which begins contractions.
CLOSING = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gains_marks(word: str) -> bool:
    """Whether letters may become letters and marks when they are composed (NFC) and put in small letters."""
    return not word.isascii() and not (unicodedata.is_normalized("NFC", word) and word.lower().isalpha())


class WordEncoder:
    """``spaced``: pieces keep the space before them (byte-level files). ``limit``: pieces remembered at once.
    ``as_loaded``: strings of added tokens in a text become these tokens, as the library does; else they are plain text."""

    def __init__(self, path: str, spaced: bool, limit: int = 800_000, as_loaded: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.spaced, self.limit = spaced, limit
        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.whole, self.letters):
            t.encode_special_tokens = True
            t.no_truncation()
            t.no_padding()
        self.whole.encode_special_tokens = not as_loaded
        # texts with an added token's string, in any case, go through the library whole
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()] if as_loaded else []
        self.added = "|".join(sorted(added))
        if not spaced:
            self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)])
        self.mark = self.letters.encode("\0", add_special_tokens=False).ids[0]
        self.closing: dict[str, bytes] = {"": b""}
        self.newline = self.encode_whole(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """The plain path: every text through the library as it is."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, stems: list[str], lead: str) -> None:
        """Put the ids of letters-only pieces into ``known``; keys without a space before them begin with a zero."""
        known, key = self.known, "" if lead or not self.spaced else "\0"
        for a in range(0, len(stems), 1000):  # small enough for the processor's cache
            some = stems[a : a + 1000]
            ids = np.array(self.letters.encode_batch_fast([lead + ("\0" + lead).join(some) + "\0"], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            raw, i = ids.tobytes(), 0
            for w, j in zip(some, (4 * ends).tolist()):
                known[key + w] = raw[i:j]
                i = j + 4

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of distinct new pieces into ``known``, but for those with white space at an end."""
        known, lead, closing = self.known, " " if self.spaced else "", self.closing
        plain = [w for w in pieces if w.isalpha()]
        marked, lines, rest = [], [], []
        for w in pieces:
            if w.isalpha():
                continue
            stem = w.rstrip(CLOSING)
            if stem.isalpha():
                marked.append((w, stem, w[len(stem) :]))
            elif not (self.spaced and (w[0].isspace() or w[-1].isspace())):
                a, _, b = w.partition("\n")
                first, second = a.rstrip(CLOSING), b.rstrip(CLOSING)
                if self.spaced and first.isalpha() and second.isalpha():
                    lines.append((w, first, a[len(first) :], second, b[len(second) :]))
                else:
                    rest.append(w)
        if not self.spaced:  # the library normalises: known or not, a stem that may gain a mark is no plain piece
            odd = {w for w in {*plain, *(x[1] for x in marked)} if gains_marks(w)}
            if odd:
                rest += [w for w in plain if w in odd] + [x[0] for x in marked if x[1] in odd]
                plain = [w for w in plain if w not in odd]
                marked = [x for x in marked if x[1] not in odd]
        need = {x[1] for x in marked}
        need.update([x[1] for x in lines])
        self._letters(list({w for w in need if w not in known}.union(plain)), lead)
        self._letters(list({x[3] for x in lines if "\0" + x[3] not in known}), "")
        ends = {x[2] for x in marked}
        ends.update([x[2] for x in lines], [x[4] for x in lines])
        ends = [c for c in ends if c not in closing]
        closing.update(zip(ends, self.encode_whole(ends)))
        for w, a, c in marked:
            known[w] = known[a] + closing[c]
        for w, a, c, b, d in lines:
            known[w] = known[a] + closing[c] + self.newline + known["\0" + b] + closing[d]
        known.update(zip(rest, self.encode_whole([lead + w for w in rest])))

    def _ids(self, pieces: list[str]) -> list[bytes | None]:
        """Two generations of known pieces: what is still in use moves from the old one to the new one."""
        if len(self.known) > self.limit // 2:
            self.old, self.known = self.known, {}
            self.closing = {"": b""}
        known = self.known
        out = list(map(known.get, pieces))
        lost = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
        if lost:
            words = [pieces[i] for i in lost]
            old = list(map(self.old.get, words))
            known.update([x for x in zip(words, old) if x[1] is not None])
            self._learn([w for w, ids in zip(words, old) if ids is None])
            for i, w in zip(lost, words):
                out[i] = known.get(w)
        return out

    def _heads(self, heads: list[str]) -> list[bytes]:
        """Ids of pieces without a space before them."""
        plain = {h for h in heads if h.isalpha() and "\0" + h not in self.known}
        self._letters(list(plain), "")
        rest = [h for h in heads if not h.isalpha()]
        have = dict(zip(rest, self.encode_whole(rest)))
        return [have[h] if h in have else self.known["\0" + h] for h in heads]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)) if self.added else []
        if not len(odd):
            return self._cut(texts)
        some = texts.take(pa.array(odd)).to_pylist()
        blank = np.zeros(len(texts), bool)
        blank[odd] = True
        out = self._cut(pc.if_else(pa.array(blank), "", texts))
        for i, ids in zip(odd.tolist(), self.encode_whole(some)):
            out[i] = ids
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """The same of texts without added tokens, by their pieces."""
        # ASCII white space ends a word of a word-level file; other white space stays inside a piece for the library
        cut = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        words, count = cut.flatten(), cut.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(count)
        coded = words.dictionary_encode()
        have = self._ids(coded.dictionary.to_pylist())
        flat = pa.array([b"" if x is None else x for x in have], pa.large_binary()).take(coded.indices)
        at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = memoryview(flat.buffers()[2] or b"")
        if not self.spaced:
            return [bytes(data[i:j]) for i, j in zip(at[ends - count].tolist(), at[ends].tolist())]
        # a text's first piece has no space before it
        heads = words.take(pa.array(ends - count)).to_pylist()
        unsafe = np.array([x is None for x in have], bool)[coded.indices.to_numpy()]
        unsafe[ends - count] = [not h or h[-1].isspace() for h in heads]
        whole = np.add.reduceat(unsafe, ends - count) > 0 if len(ends) else np.empty(0, bool)
        bodies = zip(self._heads(heads), at[ends - count + 1].tolist(), at[ends].tolist())
        out = [ids + data[i:j] for ids, i, j in bodies]
        rest = np.flatnonzero(whole).tolist()
        for i, ids in zip(rest, self.encode_whole(texts.take(pa.array(rest, pa.int64())).to_pylist())):
            out[i] = ids
        return out


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """A batch in runs of rows with about ``size`` bytes of text; a longer text is a run of its own. After each of them
    Arrow gives back the memory that it holds for the next one, which would stay with every idle worker."""
    total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def worker_encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder for all tasks of a Python worker: its words stay known, and the file is parsed once."""
    shelf = sys.modules.setdefault("_corpusloom_worker", types.ModuleType("_corpusloom_worker"))
    have = shelf.__dict__.setdefault("encoders", {})
    if (path, spaced) not in have:
        have[path, spaced] = WordEncoder(path, spaced, as_loaded=True)
    return have[path, spaced]
