"""Encoding whole texts with a ``tokenizers`` file, one distinct piece at a time.

Natural text repeats its words.  Both vocabularies used here split a text
before they merge, so a text can be cut wherever that split is certain whatever
stands on either side:

* *dropping* files (white space is removed before merging): at every ASCII
  white-space character;
* *byte-level* files: before a single space that stands between two characters
  which are not white space.

Each worker remembers the ids of the pieces it has seen, in a table of bounded
size.  New pieces of Latin letters go through :class:`MergeTable`, which applies
the file's merge list to many pieces at once with numpy; pieces with any other
character or with a special token's string go to the library itself, and so do
all texts of a file that is of neither kind.  The tests hold the outcome against
the library.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np

from statsift.llm import _common as c

#: White space other than a space or a line feed, as the broadest of the
#: libraries counts it: texts holding it are cut by the slow rule.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SAFE_CUT = re.compile(r" (?<!\s )(?!\s)")
_LATIN = re.compile("[\x00-ɏ]*")
REMEMBERED = 900_000
NO_RANK = np.int64(1) << 40
_encoders: dict[str, PieceEncoder] = {}


def byte_level_pieces(text: str) -> list[str]:
    """Pieces of ``text``; all but the first lost the space they began with.

    A piece that is followed by white space keeps it, so joining with a space
    always gives the text back."""
    odd = text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n " in text or " \n" in text or _RARE_SPACE.search(text)
    return _SAFE_CUT.split(text) if odd else text.split(" ")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    kept = set(shown)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A merge list as an open-addressed numpy table: pair -> (rank, new id)."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab = model["vocab"]
        self.word_end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.word_end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.bits = 20
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.values = np.zeros(size + 64, np.int64)
        self.probes = 1
        for rank, (a, b, new) in enumerate(self.pairs):
            key = a << 20 | b
            at = int(self._slot(np.array([key], np.int64))[0])
            step = 1
            while self.keys[at] not in (-1, key):
                at += 1
                step += 1
            self.keys[at], self.values[at] = key, rank << 20 | new
            self.probes = max(self.probes, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank << 20 | id`` of each pair, or NO_RANK."""
        keys = left << 20 | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NO_RANK)
        rest = np.flatnonzero((out == NO_RANK) & (self.keys[at] != -1))
        for step in range(1, self.probes):
            if not len(rest):
                break
            there = at[rest] + step
            hit = self.keys[there] == keys[rest]
            out[rest[hit]] = self.values[there[hit]]
            rest = rest[~hit & (self.keys[there] != -1)]
        return out

    def merge(self, words: list[bytes], closed: bool = True) -> list[bytes]:
        """Ids of each non-empty word as ``<u4`` bytes, the lowest-ranked pair merged first.

        ``closed``: the words end here; else their ends are only those of a window."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first[raw]
        if closed:
            ids[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        best = np.full(len(ids), NO_RANK)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        best[inner] = self.look_up(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(best, starts)
            counts = np.diff(np.append(starts, len(ids)))
            finished = least == NO_RANK
            if finished.any():
                gone = np.repeat(finished, counts)
                done_ids.append(ids[gone])
                done_owner.append(owner[gone])
                keep = ~gone
                ids, owner, best = ids[keep], owner[keep], best[keep]
                least, counts = least[~finished], counts[~finished]
                if not len(ids):
                    break
            target = np.repeat(least, counts)
            hit = np.flatnonzero(best == target)
            # of neighbouring hits (a pair of equal symbols) every second one merges
            run = np.concatenate(([True], np.diff(hit) != 1))
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            ids[hit] = target[hit] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            ids, owner, best = ids[keep], owner[keep], best[keep]
            near = np.concatenate((moved, moved[moved > 0] - 1))
            best[near] = NO_RANK
            near = near[near + 1 < len(ids)]
            near = near[owner[near] == owner[near + 1]]
            best[near] = self.look_up(ids[near], ids[near + 1])
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        flat = all_ids[order].astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(np.bincount(all_owner, minlength=len(words))) * 4).tolist()]
        return [flat[u:v] for u, v in zip(cuts, cuts[1:])]


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit strings of bytes."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        inner = (pre.get("pretokenizers") or [pre])[0]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.dropping = bool(plain and inner.get("type") == "Split" and inner.get("behavior") == "Removed" and inner.get("invert") and r"\s" in inner["pattern"].get("Regex", ""))
        self.byte_level = bool(plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        if self.dropping or self.byte_level:
            self.table = MergeTable(spec)
            # fixed values: the split that byte-level files without an own pattern use
            own = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.split = regex.compile(inner["pattern"]["Regex"] if self.dropping else own).findall

    def words(self, piece: str) -> list[bytes] | None:
        """The words within which a Latin piece is merged; None: ask the library."""
        if self.special(piece):
            return None
        if self.dropping:
            piece = piece.lower()
        if piece.isascii():
            if piece.isalpha():
                return [piece.encode()]
        elif not _LATIN.fullmatch(piece):
            return None
        return [w.encode() for w in self.split(piece)]

    def _learn(self, pieces: set) -> None:
        hard, easy, words = [], [], {}
        for piece in pieces:
            w = self.words(piece.decode() if self.dropping else piece)
            if w is None:
                hard.append(piece)
            else:
                easy.append((piece, w))
                for x in w:
                    words[x] = None
        if words:
            words.update(zip(list(words), self.table.merge(list(words))))
        for piece, w in easy:
            self.known[piece] = words[w[0]] if len(w) == 1 else b"".join([words[x] for x in w])
        if hard:
            texts = [p.decode() for p in hard] if self.dropping else hard
            for piece, e in zip(hard, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                self.known[piece] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; a null text is taken as an empty one."""
        if not (self.dropping or self.byte_level):
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if self.dropping:
            cut = [(t or "").encode().split() for t in texts]
        else:
            cut = []
            for t in texts:
                first, *rest = byte_level_pieces(t or "")
                cut.append(([first] if first else []) + [" " + r for r in rest])
        wanted = set().union(*cut)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = wanted
        if new:
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, c)) for c in cut]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file; loaded once in a Python process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
        c.remembered.append(_encoders.clear)
    return _encoders[path]
