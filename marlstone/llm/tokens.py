"""Token ids of whole texts, from the tokenizers library, at the speed of a dictionary.

A byte-level BPE first cuts a text into words by a pattern, and then merges within each
word alone. So the ids of a text are those of its pieces in a row, as long as each cut
lies where the pattern cuts too: before any run of white space that follows a character
which is none. A batch of texts is cut at its blanks by Arrow, each distinct piece is
looked up once, and ids are gathered by whole-array operations. Each worker keeps the ids
of pieces and words it has met, in two bounded stores; a new piece is cut by the pattern,
and its words go to the library's BPE model.

The library's own `encode(text, add_special_tokens=False)` says what the ids are. Texts
with unusual white space or with the string of an added token (a special token, say) go
to it whole, and so does every text for a vocabulary file that is of another kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

STORE = 500_000
SLICE_BYTES = 4 << 20
#: White space that Unicode knows besides space and line feed; texts with any go the plain way.
ODD = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
ODD_SPACE = re.compile(f"[{ODD}]")
WIDE_SPACE = "  |\n\n| \n|\n "
PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")
_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def cuts_at_blanks(kind: dict) -> bool:
    """Whether a vocabulary file is a byte-level BPE with the library's own word pattern."""
    before, model = kind.get("pre_tokenizer") or {}, kind["model"]
    plain = {"continuing_subword_prefix": None, "end_of_word_suffix": None, "dropout": None, "unk_token": None}
    return (
        kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        and model.get("type") == "BPE" and all((model.get(k) or None) is v for k, v in plain.items()) and not kind.get("truncation")
    )


class Encoder:
    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.known_kind = cuts_at_blanks(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[32]
        self.by_piece: dict[str, bytes] = {"": b""}
        self.by_word: dict[str, bytes] = {}
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", a) for a in added)
        self.odd = f"[{ODD}]|{WIDE_SPACE}| \\z" + (f"|{quoted}" if quoted else "")

    def merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        ids = self.by_word.get(word)
        if ids is None:
            ids = self.merged(word.encode().decode("latin-1").translate(self.letters))
            if len(self.by_word) < STORE and len(word) < 64:
                self.by_word[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        return b"".join([self.word(w) for w in self.words(piece)])

    def spaced(self, key: str) -> bytes:
        """Of a piece that a blank precedes, or that starts with its own line feed."""
        if key.isalpha():  # letters are one word of the pattern, and a mark behind them another
            ids = self.merged(self.blank + (key if key.isascii() else key.encode().decode("latin-1").translate(self.letters)))
        elif key[-1:] in ".,;:!?" and key[:-1].isalpha():
            ids = (self.by_piece.get(key[:-1]) or self.spaced(key[:-1])) + self.word(key[-1])
        else:
            ids = self.piece(key if key[:1] == "\n" else " " + key)
        if len(self.by_piece) < STORE and len(key) < 64:
            self.by_piece[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.known_kind or ODD_SPACE.search(text) or self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.piece(p) for p in PIECE.findall(text)])

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose white space is single blanks and line feeds, and how many each text has."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy().copy()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary.cast(pa.string())), " ")[0].as_py().split(" ")  # no piece holds a blank
        first = offsets[:-1] - offsets[0]
        leading, at = np.unique(codes[first], return_inverse=True)  # no blank stands before these
        codes[first] = len(names) + at
        behind = np.bincount(codes, minlength=len(names) + len(leading)) > 0
        have = self.by_piece.get
        ids = [(have(k) or self.spaced(k)) if used else b"" for k, used in zip(names, behind.tolist(), strict=False)]
        ids += [self.piece(names[c]) for c in leading.tolist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        count = sizes[codes]
        total = np.concatenate([[0], np.cumsum(count)])
        where = np.repeat((np.cumsum(sizes) - sizes)[codes] - total[:-1], count)
        where += np.arange(len(where))
        bounds = total[np.append(first, len(codes))]
        return flat[where], np.diff(bounds)

    def batches(self, column: pa.Array | pa.ChunkedArray, end_id: int):
        """For slices of a column of texts (null: empty): the row the slice starts at, all its ids (an
        end id behind each text) in a row, and the offsets of the texts in them."""
        texts = C.as_texts(column)
        for lo, hi in C.slices(texts, SLICE_BYTES):
            own = texts.slice(lo, hi - lo)
            whole = np.ones(hi - lo, bool) if not self.known_kind else pc.match_substring_regex(own, self.odd).to_numpy(zero_copy_only=False)
            n = np.zeros(hi - lo, np.int64)
            parts: dict[int, np.ndarray] = {}
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.frombuffer(self.encode(own[k].as_py()), "<u4")
                n[k] = len(parts[k])
            ids = np.zeros(0, "<u4")
            if not whole.all():
                ids, n[~whole] = self.plain(own.filter(pa.array(~whole)) if parts else own)
            at = np.concatenate([[0], np.cumsum(n + 1)])
            out = np.full(int(at[-1]), end_id, "<u4")
            free = np.ones(len(out), bool)
            free[at[1:] - 1] = False
            for k, own_ids in parts.items():
                out[at[k] : at[k] + n[k]] = own_ids
                free[at[k] : at[k + 1]] = False
            out[free] = ids
            yield lo, out, at


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file, or for a name that the installed package of public tokenizers knows."""
    if path not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[path] = Encoder(path if os.path.exists(path) else public_tokenizers.path(path), public_tokenizers.PATTERN)
    return _ENCODERS[path]
