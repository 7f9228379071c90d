"""BPE encoding and decoding as streams.

The encoder is a transducer with bounded lookahead.  From the merge list alone
it computes how many bytes to the right can still change a token (``sufficient
lookahead``); a token that ends further from the end of what has been read is
stable and is emitted.  Every text is read in chunks.  Words that end within what
has been read are emitted at once; of a word that goes on, at most a window is
held, beyond which it is merged window by window and its stable tokens are
emitted.  So the state of a text is a window, the lookahead and the start of a
special token, however long the text or its words are, in any script.  Merges of
closed words are remembered in a table of bounded size.

The decoder turns ids into bytes and bytes into text with an incremental UTF-8
state machine, which holds at most three bytes back.  Digests are kept up chunk by
chunk, so that a task holds no text's whole ids.

Files are byte-level ones with the usual split into words (``_tokens`` knows them);
others are refused with a ValueError.

Defined cases: a null text is an empty one (no ids, empty decoded text); special
tokens' strings inside a text become their ids as the library has it; bytes that
are not UTF-8 decode to U+FFFD; a very long text costs no more memory than itself
and a few chunks; repeated rows are encoded as often as they occur; an empty table
gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statsift.llm import _common as c
from statsift.llm._tokens import MergeTable, byte_symbols, encoder

CHUNK = 1 << 16
WINDOW = 1 << 10
REMEMBERED = 1 << 18
_rules: dict[str, Rules] = {}
_ids_as_text: dict[str, list[bytes]] = {}


def sufficient_lookahead(table: MergeTable, symbols: dict[int, int]) -> int:
    """Bytes to the right of a place after which nothing can change what merges across it.

    A merge (u, v) is undone only by an earlier-ranked merge (x, y) where x is v
    or one of the tokens that v ends with while it is being built.  Then y, and
    what can undo (x, y) in turn, counts too: ranks fall along such a chain, so
    the longest one is found in one pass in order of rank."""
    ends: dict[int, tuple[int, ...]] = {}
    size = dict(symbols)
    reach: dict[int, int] = {}  # of the merges so far, by their left part
    longest = 0
    for u, v, new in table.pairs:
        tail = (v, *ends.get(v, ()))
        this = size[v] + max((reach.get(x, 0) for x in tail), default=0)
        reach[u] = max(reach.get(u, 0), this)
        size[new] = size[u] + size[v]
        ends[new] = tail
        longest = max(longest, this)
    return longest


class WordMerger:
    """Ids of one word that is still being read: merged in windows, of which the
    tokens that the lookahead shows to be stable are emitted.  Holds a window and
    the lookahead at most (a window grows only where one token fills it)."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.window, self.held = rules, rules.window, b""

    def push(self, data: bytes) -> bytes:
        self.held += data
        out, table, ahead = [], self.rules.table, self.rules.lookahead
        while len(self.held) > self.window + ahead:
            part = self.held[: self.window + ahead]
            ids = np.frombuffer(table.merge([part], closed=False)[0], "<u4")
            ends = np.cumsum(self.rules.sizes[ids])
            stable = int(np.searchsorted(ends, len(part) - ahead, "right"))
            if not stable:  # a token as long as the window: read on
                self.window *= 2
                continue
            out.append(ids[:stable].tobytes())
            self.held = self.held[int(ends[stable - 1]) :]
        return b"".join(out)

    def close(self) -> bytes:
        data, self.held = self.held, b""
        return self.rules.table.merge([data])[0] if data else b""


class Rules:
    """What a byte-level file says: the merge list, its lookahead, the split into words, the special tokens."""

    def __init__(self, path: str, window: int = WINDOW) -> None:
        import regex

        tool = encoder(path)
        if not tool.byte_level:
            raise ValueError(f"{path} is not a byte-level file")
        self.table, self.window, self.split = tool.table, window, tool.split
        symbols = {int(i): 1 for i in (*tool.table.first, *tool.table.last)}
        self.lookahead = sufficient_lookahead(tool.table, symbols)
        self.sizes = np.zeros(tool.vocabulary, np.int64)
        for i in symbols:
            self.sizes[i] = 1
        for u, v, new in tool.table.pairs:
            self.sizes[new] = self.sizes[u] + self.sizes[v]
        self.specials = {t.content: np.array([i], "<u4").tobytes() for i, t in tool.library.get_added_tokens_decoder().items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        self.starts = {x[:k] for x in self.specials for k in range(1, len(x))}
        self.longest = max(map(len, self.starts), default=0)
        # how a word of each class goes on
        self.goes_on = [regex.compile(x) for x in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]
        self.known: dict[str, bytes] = {}

    def ids(self, items: list[list]) -> list[bytes]:
        """Ids of lists of closed words (text) and of what is ids already (bytes)."""
        new = {x for words in items for x in words if x.__class__ is str and x not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = {x for words in items for x in words if x.__class__ is str}
        if new:
            self.known.update(zip(new, self.table.merge([w.encode() for w in new])))
        known = self.known
        return [b"".join([known[x] if x.__class__ is str else x for x in words]) for words in items]


class Transducer:
    """The encoder of one text: ``feed`` its parts in order, then ``close``.

    Both return closed words, in order, and ids (bytes) of special tokens and of the
    stable tokens of a word that is still open.  Held are the start of a special
    token, and a word's text up to a window; a longer word goes to a WordMerger."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.tail, self.held = rules, "", ""
        self.merger: WordMerger | None = None
        self.kind = 0  # of the open word: white space, letters, numbers, others

    def feed(self, text: str, last: bool = False) -> list:
        text, self.tail = self.tail + text, ""
        rules, out, at = self.rules, [], 0
        for m in rules.special.finditer(text):
            out += self._plain(text[at : m.start()], True)
            out.append(rules.specials[m.group()])
            at = m.end()
        rest = text[at:]
        if not last:
            begun = next((k for k in range(min(len(rest), rules.longest), 0, -1) if rest[-k:] in rules.starts), 0)
            if begun:
                rest, self.tail = rest[:-begun], rest[-begun:]
        return out + self._plain(rest, last)

    def close(self) -> list:
        return self.feed("", True)

    def _plain(self, text: str, last: bool) -> list:
        """``last``: the text ends here, or a special token follows."""
        out: list = []
        if self.merger:
            run = self.rules.goes_on[self.kind].match(text).group()
            text, over = text[len(run) :], last or len(run) < len(text)
            if self.kind == 0:
                run = self.held + run
                # the last blank before a word is that word's
                self.held, run = ("", run) if over and not text else (run[-1:], run[:-1])
            out.append(self.merger.push(run.encode()))
            if not over:
                return out
            out.append(self.merger.close())
            self.merger = None
        text = self.held + text
        self.held = ""
        words = self.rules.split(text)
        if last or not words:
            return out + words
        keep = len(words[-1])
        if len(words) > 1 and words[-2][0] == "'" and len(words[-2]) + keep <= 3:
            keep += len(words[-2])  # may become a contraction
            del words[-2:]
        else:
            del words[-1]
        self.held = text[len(text) - keep :]
        if keep > self.rules.window:
            end = self.held[-1]
            self.kind = next(k for k, on in enumerate(self.rules.goes_on) if on.match(end).end())
            self.merger = WordMerger(self.rules)
            now, self.held = (self.held[:-1], end) if self.kind == 0 else (self.held, "")
            words.append(self.merger.push(now.encode()))
        return out + words


def rules_of(path: str) -> Rules:
    """The worker's rules for a byte-level file; made once in a Python process."""
    if path not in _rules:
        _rules[path] = Rules(path)
    return _rules[path]


def encode_chunks(texts: list[str | None], path: str, chunk: int = CHUNK, rules: Rules | None = None) -> Iterator[tuple[int, bytes]]:
    """``(text, ids)`` of many texts, read in step, ``chunk`` characters of each at a time."""
    rules = rules or rules_of(path)
    live = [(k, t or "", Transducer(rules)) for k, t in enumerate(texts)]
    at = 0
    while live:
        items = [machine.feed(text[at : at + chunk], at + chunk >= len(text)) for _, text, machine in live]
        yield from zip([k for k, _, _ in live], rules.ids(items))
        at += chunk
        live = [x for x in live if len(x[1]) > at]


def encode_stream(texts: list[str | None], path: str, chunk: int = CHUNK, rules: Rules | None = None) -> list[bytes]:
    """The ids of each text."""
    out: list[list[bytes]] = [[] for _ in texts]
    for k, ids in encode_chunks(texts, path, chunk, rules):
        out[k].append(ids)
    return [b"".join(parts) for parts in out]


def id_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level file stands for."""
    if path not in _ids_as_text:
        tool = encoder(path)
        back = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        table = [b""] * tool.vocabulary
        for token, i in tool.library.get_vocab(with_added_tokens=True).items():
            table[i] = b"".join(back[ch] if ch in back else ch.encode() for ch in token)
        _ids_as_text[path] = table
    return _ids_as_text[path]


class Decoder:
    """Ids to text: bytes of a few thousand ids at a time through the UTF-8 state machine."""

    def __init__(self, path: str, step: int = 1 << 14) -> None:
        self.table, self.step = id_bytes(path).__getitem__, step
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return "".join([self.machine.decode(b"".join(map(self.table, ids[i : i + self.step]))) for i in range(0, len(ids), self.step)])

    def close(self) -> str:
        return self.machine.decode(b"", True)


def decode_stream(ids: bytes, path: str, step: int = 1 << 14) -> str:
    """The text of ``<u4`` ids."""
    decoder = Decoder(path, step)
    return decoder.feed(np.frombuffer(ids, "<u4").tolist()) + decoder.close()


class _Digests:
    """Number of ids, digest of the ids, digest of the decoded text, kept up chunk by chunk."""

    def __init__(self, path: str) -> None:
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(path)

    def add(self, ids: bytes) -> None:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if numbers:
            self.ids.update(("," * (self.n > 0) + str(numbers)[1:-1].replace(" ", "")).encode())
            self.n += len(numbers)
            self.text.update(self.decoder.feed(numbers).encode())

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.close().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _round_trip(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    rows = []
    for part in c.slices(batch, "text"):
        texts = part.column("text").to_pylist()
        kept = [_Digests(path) for _ in texts]
        for k, ids in encode_chunks(texts, path):
            kept[k].add(ids)
        rows += [d.row() for d in kept]
    counts, ids, texts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from the ids."""
    rows = c.pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(c.per_batch(_round_trip, path=os.fspath(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
