"""Packing (operator 11): best-fit decreasing over a segment tree indexed by remaining capacity.

Overlong documents are first cut into full windows, which stay where they are.  The rests, at most one per document, are
dealt to groups of bounded size; each group places them longest first, always in the tightest open window.  Windows that
end with free places are then filled up with pieces cut off the loosest ones, so that a group is left with at most one window
that would need padding; that one is cut at powers of two, where no padding is needed.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, saved, table
from .token_ids import any_of, hugging, specials

#: Rests packed together in one task.
GROUP = 4096
#: Bytes of ids after which a task hands on what it has.
FLUSH = 1 << 24
#: Runs with characters beyond the plain ones whose ids a worker remembers, and the longest of them.
KNOWN, LONGEST = 1 << 19, 64

Part = tuple[int, int, int]  # item, tokens of the item before, tokens


#: Characters that the tokenizer's normaliser and splitter treat plainly: ASCII, Latin letters and some marks.  Composed
#: forms stay as they are, lower case is a character's own, and each is known to be a letter or a mark.
LETTERS, MARKS = "À-ÖØ-öø-įı-ſ", "¡§«°·»¿–—‘-„…€"
SPACE, PLAIN = r"\x20\x09-\x0D", rf"\x01-\x7F{LETTERS}{MARKS}"
#: How the splitter reads plain text in lower case: contractions, words, single digits, and runs of anything else.
SPLITTER = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^{SPACE}a-z0-9{LETTERS}]+"
#: A run with any other character, from its first one; and a run so long that merging is left to the library.
OTHER = rf"((?<![^{SPACE}])(?:(?![{SPACE}])[{PLAIN}])*+[^{PLAIN}][^{SPACE}]*+)"
LONG = rf"[^{SPACE}]{{{1000}}}"


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit values in bytes, of a tokenizer with word ends that composes and lower-cases
    characters, drops white space, and splits at contractions, words, digits and marks.

    Plain text is split here and merged by tiktoken, where a word's end is a zero byte: ids are the merges' ranks, and the
    ids of bytes that end a word come before all other merges, as the tokenizer begins with them.  Runs (between ASCII white
    space) with other characters go to the library, once each, and so do texts with a special string or a very long
    run.  A test compares the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.known = hugging(path), {}
        self.runs, self.split, self.other, self.long = (getattr(re.compile(p), f) for p, f in ((WORD, "findall"), (SPLITTER, "findall"), (OTHER, "split"), (LONG, "search")))
        self.odd, self.special = re.compile(f"[^{PLAIN}]").search, any_of(specials(self.tok)).search
        # Byte-level alphabets write bytes as characters: printable ones as themselves, the others from 256 on.
        printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        hidden = [b for b in range(256) if b not in printable]
        byte = {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(hidden)}}
        assert set(byte) == set(ByteLevel.alphabet())
        end, special = "</w>", specials(self.tok)
        ranks = {bytes(byte[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end): i for t, i in self.tok.get_vocab().items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _plain(self, text: str) -> bytes:
        pieces = self.split(text.lower())
        return array("I", self.merge("\0".join(pieces) + "\0")).tobytes() if pieces else b""

    def _run(self, run: str) -> bytes:
        found = self.known.get(run)
        if found is None:
            found = array("I", self.tok.encode(run, add_special_tokens=False).ids).tobytes()
            if len(run) <= LONGEST:
                if len(self.known) > KNOWN:
                    self.known.clear()
                self.known[run] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.special(text) or self.long(text):
            out = b"".join(map(self._run, self.runs(text)))
        elif not self.odd(text):
            out = self._plain(text)
        else:  # plain stretches and, in between, runs with other characters
            out = b"".join(self._run(part) if i & 1 else self._plain(part) for i, part in enumerate(self.other(text)))
        if sys.byteorder == "big":
            out = b"".join(out[i : i + 4][::-1] for i in range(0, len(out), 4))
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, *, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids: every document's full windows, and its rest.  Narrow, one pass."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = _encoder(tokenizer), end_id.to_bytes(4, "little")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "doc_tokens", "start", "length", "ids"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    rows.append((doc_id, n, start, min(size, n - start), ids[4 * start : 4 * (start + size)]))
                held += len(ids)
                if held > FLUSH:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids binary")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over the capacities, whose nodes count the windows below."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, n: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least n, the one opened last of several: (room, window)."""
        node = self.leaves + n
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger under its parent
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[Part]]:
    """Windows of items, given longest first: each item goes to the tightest open window that holds it, or to a new one."""
    windows: list[list[Part]] = []
    rooms = OpenWindows(size)
    for item, n in enumerate(lengths):
        room, w = rooms.tightest(n) or (size, len(windows))
        if w == len(windows):
            windows.append([])
        windows[w].append((item, 0, n))
        if room > n:
            rooms.add(room - n, w)
    return windows


def _used(window: list[Part]) -> int:
    return sum(n for _, _, n in window)


def padding(used: int, size: int) -> int:
    """A window is padded to its size, except at a power of two."""
    return size - used if used & (used - 1) else 0


def filled(windows: list[list[Part]], size: int) -> list[list[Part]]:
    """The windows with no padding at all: the tightest are filled with pieces of the loosest, and the last one that would
    be padded is cut at powers of two."""
    done = [w for w in windows if not padding(_used(w), size)]
    loose = deque(sorted((w for w in windows if padding(_used(w), size)), key=lambda w: (-_used(w), w[0])))
    while len(loose) > 1:
        window = loose.popleft()
        room = size - _used(window)
        while room and loose:
            item, start, n = loose[-1].pop()
            window.append((item, start, min(room, n)))
            if n > room:
                loose[-1].append((item, start + room, n - room))
            if not loose[-1]:
                loose.pop()
            room -= min(room, n)
        if room:
            loose.append(window)
        else:
            done.append(window)
    for window in loose:
        rest = deque(window)
        for bit in reversed(range(_used(window).bit_length())):
            if _used(rest) >> bit & 1:
                done.append(_head(rest, 1 << bit))
    return done


def _head(parts: deque[Part], n: int) -> list[Part]:
    """Takes the first n tokens off the parts."""
    out = []
    while n:
        item, start, m = parts.popleft()
        out.append((item, start, min(n, m)))
        if m > n:
            parts.appendleft((item, start + n, m - n))
        n -= min(n, m)
    return out


def packed(docs: DataFrame, *, tokenizer: str, size: int = 2048, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Packs every document's ids, with ``end_id`` after them, into sequences of at most ``size`` tokens without padding.

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).
    A sequence is as long as its pieces: ``size`` tokens, or a power of two.

    Documents over ``size`` tokens are cut into full windows, each a sequence.  The rests are dealt to groups of about
    ``group`` by a hash of their row, and every group is packed in one task that holds at most ``group`` times ``size`` ids,
    whatever a source or document is: best fit decreasing first, then each window with free places is filled by a cut of
    the loosest one.  A group leaves at most one window to be cut at powers of two.

    ``tokenizer``: a file of the tokenizers library whose splitter drops white space.  Null or empty text: one piece that
    holds end_id alone.  Null doc_id: kept as null.  Repeated rows: each is a document of its own.  Ties in length go by
    doc_id (nulls first), start and row.  Very long texts are cut as any other.  Empty table: no rows.  Other columns of docs
    are ignored, whatever their names.
    """
    cuts = saved(pieces(docs, tokenizer=tokenizer, size=size, end_id=end_id).withColumn("row", F.monotonically_increasing_id()))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    whole = cuts.filter(F.col("length") == size).withColumns({"sequence_id": F.col("row") * 2 + 1, "offset": F.lit(0).cast("long")}).select(names)
    rests = cuts.filter(F.col("length") < size)
    groups = max(1, -(-rests.count() // group))

    def run(key, t):
        import pyarrow as pa

        rows = t.select(["doc_id", "start", "length", "doc_tokens", "row"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (-rows[i]["length"], rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, rows[i]["start"], rows[i]["row"]))
        ids, out = t.column("ids"), []
        for number, window in enumerate(filled(best_fit_decreasing([rows[i]["length"] for i in order], size), size)):
            at = 0
            for item, start, n in window:
                r = rows[order[item]]
                out.append((r["doc_id"], r["start"] + start, n, r["doc_tokens"], (key[0].as_py() << 32) + 2 * number, at, ids[order[item]].as_py()[4 * start : 4 * (start + n)]))
                at += n
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names)

    dealt = rests.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = packed(table(spark, sf_dir, "documents"), tokenizer=P.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
