"""Alignment of the tokens that two tokenizers cut one text into.

Each tokenizer says which characters a token covers: character offsets of ``tokenizers``,
spans of ``sentencepiece`` (its immutable proto, which the installed version returns as an
offset mapping). These are coarse cuts. Several tokens may share one character of more than
a byte, and a byte that no piece covers has a token of its own; there the decoded bytes of
the tokens tell where each ends. Byte offsets at which tokens of both end cut the text into
groups, and the two tokens that end there are linked.

Neither tokenizer joins characters across a single space between two words, so a text falls
apart into segments at those spaces, and a segment is aligned once while a task remembers it.
Whether that holds is read from the tokenizers; if not, a text is one segment.

Tokens that are linked end in the same bytes, so one is a suffix of the other. The pairs for
which that can be are listed from the vocabularies: fewer than the bytes of all tokens, a
bound no corpus changes. Counts of pairs are kept by their number in that list.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from kudoscope.llm import common
from kudoscope.session import materialise

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOGETHER = 200          # segments encoded in one go
REMEMBERED = 250_000    # segments a worker remembers
_SLICE = 500_000        # bytes of text worked on at a time
_SPACE = "▁"
_CUT, _RUN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones
    stand for themselves, the rest follow from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers and what a worker remembers of the segments it has aligned."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        spec = json.loads(byte_bpe)
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_of_letter()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        size = self.a.get_vocab_size()
        self.bytes_a = [added.get(i) or bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(size)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(names))])
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(_SPACE, " ").encode()
                        for i, p in enumerate(names)]
        self.long_a, self.long_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(size, len(names)))]
        self.pairs = self._possible_pairs()
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                        and not split.get("add_prefix_space")
                        and not any(t["content"].count(" ") for t in spec.get("added_tokens", []))
                        and not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names))
        self.forget()

    def _possible_pairs(self) -> np.ndarray:
        """Ascending ``a * size_b + b`` of all tokens of which one is a suffix of the other."""
        def by_bytes(tokens):
            found: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                found.setdefault(t, []).append(i)
            return found

        of_a, of_b, size = by_bytes(self.bytes_a), by_bytes(self.bytes_b), len(self.bytes_b)
        out = {a * size + b for t, ids in of_a.items() for at in range(len(t)) for b in of_b.get(t[at:], ()) for a in ids}
        out |= {a * size + b for t, ids in of_b.items() for at in range(len(t)) for a in of_a.get(t[at:], ()) for b in ids}
        return np.array(sorted(out), dtype=np.int64)

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b = array("i"), array("i")     # -1 where the tokens don't give back the bytes
        self.groups, self.fresh = pa.array([], pa.large_string()), []   # fresh: those not yet in the Arrow array
        self.linked, self.until = array("i"), array("q", [0])
        self.used = np.zeros(0, dtype=np.int64)

    def forget_rare(self) -> None:
        """Keep the segments that were used most, half of those there is room for."""
        names, groups = list(self.number), self.packed_groups()
        n_a, n_b, until = (np.array(x) for x in (self.n_a, self.n_b, self.until))
        linked = np.array(self.linked, dtype=np.int32)
        kept = np.argsort(-self.used, kind="stable")[:REMEMBERED // 2]
        self.forget()
        longs = until[kept + 1] - until[kept]
        total = np.concatenate([[0], np.cumsum(longs)])
        self.linked = array("i", linked[np.repeat(until[kept] - total[:-1], longs) + np.arange(total[-1])].tobytes())
        self.until = array("q", total.tobytes())
        self.n_a, self.n_b = array("i", n_a[kept].tobytes()), array("i", n_b[kept].tobytes())
        self.number = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.groups = groups.take(pa.array(kept))

    def packed_groups(self) -> pa.LargeStringArray:
        """The groups of all remembered segments; an Arrow array, as strings of Python take several times the memory."""
        if self.fresh:
            self.groups = pa.concat_arrays([self.groups, pa.array(self.fresh, pa.large_string())])
            self.fresh = []
        return self.groups

    def segments(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        if text[0].isspace() or text[-1].isspace() or _RUN.search(text):
            return _CUT.split(text)
        return text.split(" ")      # the same, where all white space stands alone

    def learn(self, segments: list[str]) -> None:
        """Align segments that are not remembered yet."""
        plain, alone = [], []
        for s in segments:
            (plain if self.by_word and s.strip() == s and _SPACE not in s else alone).append(s)
        for s in alone:
            self._align([s])
        for at in range(0, len(plain), TOGETHER):
            self._align(plain[at:at + TOGETHER])

    def _align(self, segments: list[str]) -> None:
        text = " " + " ".join(segments)
        raw = text.encode()
        token_a = self.a.encode(text, add_special_tokens=False)
        token_b = self.b.encode(text[1:], return_type="offset_mapping")
        list_a, list_b = token_a.ids, token_b["ids"]
        if not (b"".join([self.bytes_a[i] for i in list_a]) == raw == b"".join([self.bytes_b[i] for i in list_b])):
            if len(segments) > 1:
                for s in segments:
                    self._align([s])
            else:
                self._remember(segments, [-1], [-1], [""], [], [0])
            return
        ids_a, ids_b = np.array(list_a, dtype=np.int64), np.array(list_b, dtype=np.int64)
        # where each character ends, in bytes
        if len(raw) == len(text):
            upto = np.arange(len(text) + 1)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            upto = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        offsets = np.fromiter(chain.from_iterable(token_a.offsets), dtype=np.int64, count=2 * len(ids_a))
        start, end = offsets[::2], offsets[1::2]
        within = np.append(start[1:] < end[:-1], False)     # the next token goes on in this character
        ends_a = np.where(within, np.cumsum(self.long_a[ids_a]), upto[end])
        spans = np.fromiter(chain.from_iterable(token_b["offsets"]), dtype=np.int64, count=2 * len(ids_b))
        # the text that sentencepiece sees lacks the first space, which it adds itself
        ends_b = np.where(self.is_byte[ids_b], np.cumsum(self.long_b[ids_b]), upto[spans[1::2] + 1])
        both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        pairs = np.searchsorted(self.pairs, ids_a[at_a] * len(self.bytes_b) + ids_b[at_b])
        name_a, name_b = [self.names[i] for i in list_a], [self.names[i] for i in list_b]
        cut_a, cut_b = np.concatenate([[0], at_a + 1]), np.concatenate([[0], at_b + 1])
        list_a, list_b = cut_a.tolist(), cut_b.tolist()
        groups = [f"{name_a[i]}|{name_b[k]}" if j - i == m - k == 1 else
                  f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}"
                  for i, j, k, m in zip(list_a, list_a[1:], list_b, list_b[1:])]
        sizes = [len(s) + 1 for s in segments] if len(raw) == len(text) else [len(s.encode()) + 1 for s in segments]
        cut = np.concatenate([[0], np.searchsorted(both, np.cumsum(sizes), side="right")])
        edges = cut.tolist()
        self._remember(segments, np.diff(cut_a[cut]), np.diff(cut_b[cut]),
                       [";".join(groups[i:j]) for i, j in zip(edges, edges[1:])], pairs, cut[1:])

    def _remember(self, segments, n_a, n_b, groups, pairs, upto) -> None:
        """``pairs`` of all segments, those of each up to its number in ``upto``."""
        first, links = len(self.n_a), self.until[-1]
        self.number.update(zip(segments, range(first, first + len(segments))))
        self.n_a.frombytes(np.asarray(n_a, dtype=np.int32).tobytes())
        self.n_b.frombytes(np.asarray(n_b, dtype=np.int32).tobytes())
        self.fresh += groups
        self.linked.frombytes(np.asarray(pairs, dtype=np.int32).tobytes())
        self.until.frombytes((np.asarray(upto, dtype=np.int64) + links).tobytes())

    def ends(self, groups: str) -> list[int]:
        """Bytes up to the end of each group."""
        found, at = [], 0
        for group in groups.split(";") if groups else ():
            at += sum(len(self.bytes_a[int(i)]) for i in group.partition("|")[0].split(","))
            found.append(at)
        return found

    def documents(self, texts: list[str | None]) -> list[pa.Array]:
        """``n_a, n_b, groups, links`` of each text."""
        if len(self.number) > REMEMBERED:
            self.forget_rare()
        cut = [self.segments(t) if t else [] for t in texts]
        flat = [s for c in cut for s in c]
        numbers = list(map(self.number.get, flat))
        new = [k for k, n in enumerate(numbers) if n is None]
        if new:
            self.learn(list(dict.fromkeys(flat[k] for k in new)))
            for k in new:
                numbers[k] = self.number[flat[k]]
        codes, size = np.array(numbers, dtype=np.int64), np.array([len(c) for c in cut])
        upto = np.concatenate([[0], np.cumsum(size)])
        groups = self.packed_groups()
        uses = np.bincount(codes, minlength=len(groups))
        uses[:len(self.used)] += self.used
        self.used = uses

        def sums(values: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values)])
            return running[upto[1:]] - running[upto[:-1]]

        n_a, n_b, until = (np.array(x) for x in (self.n_a, self.n_b, self.until))
        fine = sums(n_a[codes] < 0) == 0
        codes = codes[np.repeat(fine, size)]
        upto = np.concatenate([[0], np.cumsum(np.where(fine, size, 0))])
        longs = until[codes + 1] - until[codes]
        total = np.concatenate([[0], np.cumsum(longs)])
        places = np.repeat(until[codes] - total[:-1], longs) + np.arange(total[-1])
        links = np.array(self.linked, dtype=np.int32)[places]
        said = groups.take(pa.array(codes)).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), said), ";")
        return [pa.array(sums(n_a[codes])), pa.array(sums(n_b[codes])), joined,
                pa.ListArray.from_arrays(pa.array(total[upto].astype(np.int32)), pa.array(links))]


@lru_cache(maxsize=2)
def _aligner(key: str, byte_bpe: str, pieces: bytes) -> Aligner:
    return Aligner(byte_bpe, pieces)


class Tokenizers:
    """The two tokenizer files as they are, at most a few MB; every worker builds them once."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        self.byte_bpe, self.pieces = byte_bpe, pieces
        self.key = hashlib.sha256(byte_bpe.encode() + pieces).hexdigest()

    @classmethod
    def of(cls, folder: str = FOLDER) -> Tokenizers:
        with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as a, open(f"{folder}/{PIECES}", "rb") as b:
            return cls(a.read(), b.read())

    def aligner(self) -> Aligner:
        return _aligner(self.key, self.byte_bpe, self.pieces)


def align(docs: DataFrame, tokenizers: Tokenizers, with_ends: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, groups, links`` for every row of ``docs`` (doc_id, text).

    The first tokenizer reads a space and the text, the second the text, before which it
    puts that space itself. ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group, those
    of the first tokenizer before the bar. ``links`` holds, for each group, the number of its
    last two tokens in ``Aligner.pairs``; ``ends``, if asked for, the bytes of space and text
    up to its end. A null or empty text, and one whose bytes the tokens of either don't give
    back, has no tokens. Strings of special tokens are plain text. Texts are read whole, a
    row on its own: nothing is shuffled. Rows that repeat stay; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def aligned(batches):
        aligner = shared.value.aligner()
        for batch in batches:
            text = batch.column("text")
            before = np.concatenate([[0], np.cumsum(pc.binary_length(text).fill_null(0).to_numpy())])
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(before, before[at] + _SLICE, side="right")) - 1)
                columns = aligner.documents(text.slice(at, upto - at).to_pylist())
                if with_ends:
                    columns.append(pa.array([aligner.ends(g) for g in columns[2].to_pylist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, upto - at), *columns], names)
                at = upto

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, groups string, links array<int>"
    schema += ", ends array<long>" if with_ends else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links hold a pair, over all documents."""
    return aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def link_scores(aligned: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` instead of ``links``.

    A link's count is that of its pair in all of ``aligned``; it is best if no pair with the
    same second token has a higher one. The counts, one number for each possible pair of
    the vocabularies, go to the workers as one array.
    """
    aligner, spark = tokenizers.aligner(), aligned.sparkSession
    counted = pair_counts(aligned).toArrow()
    counts = np.zeros(len(aligner.pairs), dtype=np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    second = aligner.pairs % len(aligner.bytes_b)
    top = np.zeros(len(aligner.bytes_b), dtype=np.int64)
    np.maximum.at(top, second, counts)
    shared = spark.sparkContext.broadcast((counts, counts == top[second]))
    at = aligned.columns.index("links")

    def scored(batches):
        _aligner.cache_clear()      # what this worker remembers of segments is of no more use
        count, best = shared.value
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                some = batch.slice(row, 256)
                links = some.column(at)
                pairs = links.flatten().to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(np.diff(links.offsets.to_numpy()))])
                sums = [np.concatenate([[0], np.cumsum(v[pairs])]) for v in (best, count)]
                columns = [c for i, c in enumerate(some.columns) if i != at]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array((s[edges[1:]] - s[edges[:-1]]).astype(np.int64)) for s in sums], names)

    kept = [f for f in aligned.schema if f.name != "links"]
    names = [*[f.name for f in kept], "n_best", "count_sum"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in kept]
    return aligned.mapInArrow(scored, ", ".join([*kinds, "n_best long", "count_sum long"]))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the sizes of its alignment and how common its links are."""
    tokenizers = Tokenizers.of()
    links = F.size("links").cast("long")
    aligned = align(common.table(spark, sf_dir, "documents"), tokenizers).select(
        "doc_id", "n_a", "n_b", links.alias("n_groups"), links.alias("n_links"),
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "links")
    return link_scores(materialise(aligned, "alignment"), tokenizers)
