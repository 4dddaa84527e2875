"""BPE encoding and decoding with content-defined chunk reuse.

A text of any length is cut where a rolling hash of the last eight bytes falls below a threshold, so a passage that
several documents share gives the same chunks wherever it stands. A chunk is encoded once and kept in a bounded
cache of the worker; equal chunks of later documents reuse its ids. Cuts fall anywhere, also within a word, so each
join is repaired: the pieces of the cut word are joined again, piece by piece up to the blanks on either side, and
where the ids of the pieces do not agree with those of the whole word, the latter replace them. A blank ends every
pre-token, so beyond it both sides agree exactly and no wider window is needed.

A run without blanks of more than ``RUN_BYTES`` is one chunk of its own: it is encoded whole, once, in the time that
the library takes for it, and no repair ever covers more than ``RUN_BYTES``.

Chunks are encoded by blank-separated words through a second bounded cache. That is exact for a tokenizer whose
pre-tokens never span ASCII blanks and drop them; ``Encoder`` checks this for the file it loads, and leaves all to
the library otherwise. Reuse is within one worker and not through a shuffle: a global exchange of chunks would move
every text and its ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean chunk length in bytes (a power of two), entries of the word cache, bytes of the chunk cache.
CHUNK_BYTES, WORDS_KEPT, CHUNK_CACHE_BYTES = 512, 400_000, 48_000_000
#: Longer runs without blanks are never cut.
RUN_BYTES = 256
#: Longer words are encoded each time and never kept.
WORD_BYTES = 64
#: A comma or full stop between a letter and a blank is a pre-token of its own.
_STOP = re.compile(rb"([a-z])([,.])(?=\s|$)")
_MARK = b"\x01"
_UPPER = ["Hello World, ABC", "The. END", "Éa ZÜ x"]
_STOPPED = ["hello, world. x. y,", "wörter, élan. zzqxj, ñandú."]
_PROBES = ["a b", "it's  a\ttest\n\nof \x0b\x0c\r blanks", "Ab12 <|endoftext|> x", " - -- 'S 're", "é ́ x y"]


class Encoder:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit bytes, equal to the library's."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT, chunk_bytes: int = CHUNK_BYTES, chunk_cache_bytes: int = CHUNK_CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.words_kept, self.chunk_bytes, self.chunk_cache_bytes = words_kept, chunk_bytes, chunk_cache_bytes
        # Chunks used since the last turn, and those of the turn before, which go when the new ones fill their half.
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunk_load = self.met = self.reused = self.repaired = 0
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.plain_decode = all(self.tok.decode(ids, skip_special_tokens=False) == " ".join(self.names[i] for i in ids) for ids in ([], [0, 1, size - 1], self.tok.encode(" ".join(_PROBES), add_special_tokens=False).ids))
        self.by_word = all(self.tok.encode(p, add_special_tokens=False).ids == [i for w in p.encode().split() for i in self.tok.encode(w.decode(), add_special_tokens=False).ids] for p in _PROBES)
        same = lambda a, b: self.tok.encode(a, add_special_tokens=False).ids == self.tok.encode(b, add_special_tokens=False).ids
        normal = json.dumps(json.loads(self.tok.to_str()).get("normalizer"))
        self.lowers = '"Lowercase"' in normal and all(same(p, p.encode().lower().decode()) for p in _UPPER)
        self.stops = all(same(p, _STOP.sub(rb"\1 \2", p.encode()).decode()) for p in _STOPPED)
        mark = self.tok.encode("\x01", add_special_tokens=False).ids
        self.mark_id = mark[0] if self.by_word and len(mark) == 1 else None
        self.bare = self._bare(path) if self.mark_id is not None else None

    def _bare(self, path: str):
        """The model behind a plain blank split, if the file marks ends of words and agrees on some words."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([n.endswith(suffix) for n in self.names])
        words = "the able wörter élan zzqxj ñandú".split()
        same = all(bare.encode(w, add_special_tokens=False).ids == self.tok.encode(w, add_special_tokens=False).ids for w in words)
        return bare if same else None

    def _raw(self, texts: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of single words, many in one call.

        Words of lower-case letters in normal form are one pre-token each and need no normaliser: the model
        alone encodes them, and a token with the end-of-word suffix ends each. Other words are told apart by
        a mark that stands between them as a word.
        """
        if self.mark_id is None:
            return dict(zip(words, self._raw(words)))
        out: dict[bytes, bytes] = {}
        letters, plain, apart = [], [], []
        for w in words:
            t = w.decode()
            if self.bare is not None and t.isalpha() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t)):
                letters.append(w)
            else:
                (apart if _MARK in w or b"<|" in w else plain).append(w)
        out |= zip(apart, self._raw(apart))
        for tok, all_, glue in ((self.bare, letters, b" "), (self.tok, plain, b" " + _MARK + b" ")):
            for at in range(0, len(all_), 4096):
                some = all_[at : at + 4096]
                ids = np.array(tok.encode_batch_fast([glue.join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
                raw, begin = ids.tobytes(), 0
                if tok is self.bare:
                    ends, skip = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), 0
                else:
                    ends, skip = [*(np.flatnonzero(ids == self.mark_id) * 4).tolist(), len(raw)], 4
                if len(ends) != len(some):
                    out |= zip(some, self._raw(some))
                    continue
                for w, end in zip(some, ends):
                    out[w] = raw[begin:end]
                    begin = end + skip
        return out

    def _plain(self, text: bytes) -> bytes:
        """The text in a form with the same ids and fewer different words, as far as the probes allow."""
        if b"<|" in text:
            return text
        text = text.lower() if self.lowers else text
        return _STOP.sub(rb"\1 \2", text) if self.stops else text

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by its blank-separated words, through the word cache."""
        if not self.by_word:
            return self._raw(texts)
        # Special tokens are told by their case, so only texts without "<|" are put in lower case first.
        lists = [self._plain(t).split() for t in texts]
        used = set().union(*lists)
        missing = list(used.difference(self.words))
        if missing:
            if len(self.words) + len(missing) > self.words_kept:
                # The oldest entries are the frequent words; they, the newest and those in use stay.
                items, part = list(self.words.items()), self.words_kept // 4
                self.words = dict(items[:part] + [(w, i) for w, i in items[part:-part] if w in used] + items[-part:])
            self.words.update(self._fresh(missing))
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in lists]
        for w in missing:
            if len(w) > WORD_BYTES or len(self.words) > self.words_kept:
                del self.words[w]
        return out

    def cuts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which chunks end, but for the last, and the blanks of the text with a blank at either end.

        A cut is between code points and fixed by the eight bytes before it, or by a long run without blanks.
        """
        n = len(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        blanks = np.r_[-1, np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13))), n]
        at = np.zeros(0, dtype=np.int64)
        if n > 8:
            eight = np.ndarray((n - 8,), dtype="<u8", buffer=data, strides=(1,))  # the rolling window at each position
            with np.errstate(over="ignore"):
                rolled = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            at = np.flatnonzero(rolled < (1 << 24) // self.chunk_bytes) + 8
            at = at[(raw[at] & 0xC0) != 0x80]
        long = np.flatnonzero(np.diff(blanks) > RUN_BYTES + 1)
        if len(long):
            inside = np.isin(np.searchsorted(blanks, at) - 1, long)
            at = np.unique(np.r_[at[~inside], blanks[long] + 1, blanks[long + 1]])
        return at[(at > 0) & (at < n)], blanks

    def encode_chunked(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by chunks, each encoded once while the cache holds it, with repaired joins."""
        if not self.by_word:
            return self._raw(texts)
        # Of each chunk: itself, the piece at its start that goes on a cut word, the piece at its end that is cut.
        plans, edges, fresh, known = [], set(), {}, {}
        for data in texts:
            at, blanks = self.cuts(data)
            place = np.searchsorted(blanks, at)
            begin, end = (blanks[place - 1] + 1).tolist(), blanks[place].tolist()
            plan, last, head = [], 0, b""
            for p, a, b in zip([*at.tolist(), len(data)], [*begin, len(data)], [*end, 0]):
                chunk, tail = data[last:p], data[max(a, last) : p] if p < b else b""
                plan.append((chunk, head[: len(chunk)], tail))
                if tail:
                    edges.update((tail, data[a:b]))
                if head:
                    edges.add(head[: len(chunk)])
                last, head = p, data[p:b] if a < p else b""
                if chunk not in known and chunk not in fresh:
                    got = self.chunks.get(chunk)
                    if got is None and (got := self.older.get(chunk)) is not None:
                        self._keep(chunk, got)
                    (fresh if got is None else known)[chunk] = got
            plans.append(plan)
            self.met += len(plan)
        todo, edge = list(fresh), list(edges)
        ids = self.encode_many(todo + edge)
        fresh, word = dict(zip(todo, ids)), dict(zip(edge, ids[len(todo) :]))
        known |= fresh
        self.reused += sum(map(len, plans)) - len(fresh)
        out = []
        for plan in plans:
            parts: list[bytes] = []
            pieces: list[bytes] = []  # of the cut word
            for chunk, head, tail in plan:
                got = known[chunk]
                if head:
                    pieces.append(head)
                    if tail and head == chunk:
                        continue  # cut again within the same word
                    got = got[len(word[head]) :]
                    whole, apart = word[b"".join(pieces)], b"".join(map(word.__getitem__, pieces))
                    self.repaired += whole != apart
                    parts.append(whole)
                    pieces = []
                if tail:
                    pieces = [tail]
                    got = got[: len(got) - len(word[tail])]
                parts.append(got)
            out.append(b"".join(parts))
        for chunk, own in fresh.items():
            self._keep(chunk, own)
        return out

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        load = len(chunk) + len(ids) + 130  # with what Python holds beside
        if 4 * load > self.chunk_cache_bytes:
            return
        if 2 * (self.chunk_load + load) > self.chunk_cache_bytes:
            self.older, self.chunks, self.chunk_load = self.chunks, {}, 0
        self.chunks[chunk] = ids
        self.chunk_load += load

    def decode(self, ids: bytes) -> str:
        got = np.frombuffer(ids, dtype="<u4").tolist()
        if self.plain_decode:
            return " ".join(map(self.names.__getitem__, got))
        return self.tok.decode(got, skip_special_tokens=False)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file; its caches live as long as the worker."""
    return Encoder(path)


def _encoder(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                ids = enc.encode_chunked(texts)
                columns = [part.column(0), pa.array(ids, pa.binary())]
                names = ["doc_id", "ids"]
                if decoded:
                    columns.append(pa.array([enc.decode(i) for i in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit), and ``decoded`` from these ids if asked for.

    Defined cases: a null text is empty; an empty text has no ids and decodes to an empty text; strings of
    special tokens in a text become those tokens, as in the library; repeated rows each give a row; an empty
    table gives no rows; texts of any length are encoded whole.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_encoder(path, decoded), "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def code_report(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    coded = encode(docs, path, decoded=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
