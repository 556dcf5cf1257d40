"""Byte-pair encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged
over: every intermediate symbol of byte-pair encoding is itself a token. Such
pairs therefore mark certain cuts. A text is cut at them, the fragments are
encoded independently of each other (each distinct fragment once per worker, as
texts repeat their fragments), and the results are concatenated. Decoding takes
nothing but the ids.

Cuts are taken at two levels. White space of ASCII is in no token, so the text is
cut there first; the normaliser and the pre-tokeniser never look across it. The
words that the pre-tokeniser makes of a fragment are then cut at the remaining
pairs; only the last piece of a word carries the word-end suffix.

Results for odd input: a null text counts as empty; an empty text has no ids and
decodes to an empty text; strings of special tokens in a text become these tokens,
as in the tokenizers library; repeated rows give repeated results; ids that are null,
or bytes that are no whole number of ids, decode to null; so do ids of no token.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Bytes, with what the interpreter adds, of the fragments that a worker remembers, in two halves: a full half becomes the old
#: one, and what is asked for again moves on from there, so that only what has not been seen for long is forgotten.
CACHE_BYTES, ENTRY_BYTES = 144 << 20, 220
# Probes of a pre-tokeniser: where it cuts each of these as the short cut does, the short cut is taken.
PROBES = ("abc", "a1b22", "ab.cd,(ef)!", "x-1", "2024/05", "a_b", "...", "7")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryEncoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library that has a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = BPE(model["vocab"], merges)
        self.last = BPE(model["vocab"], merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = self.whole.get_vocab(with_added_tokens=True)
        self.id_bytes = {i: i.to_bytes(4, "little") for i in tokens.values()}
        # without a decoder of its own the library joins tokens with blanks
        self.token_of = {i: t for t, i in tokens.items()} if spec.get("decoder") is None else None
        byte = _byte_of_char()
        self.joined = {t[i : i + 2] for t in (x.removesuffix(self.suffix) for x in self.vocab) for i in range(len(t) - 1)}
        used = {byte[c] for pair in self.joined for c in pair}
        #: White space that no pair inside a token has: each occurrence is a certain cut.
        self.blank = bytes(b for b in b" \t\n\r\x0b\x0c" if b not in used)
        if len(self.blank) < 6:
            raise ValueError("a token of this vocabulary holds white space")
        # pieces that the pre-tokeniser's pattern makes of lower-case ASCII without apostrophes, if this file's does so
        self.ascii_words = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
        self.plain = all(self._cut(x) == self.ascii_words.findall(x) for x in PROBES) and self._cut("AbC") == ["abc"]
        self.words: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_ids: dict[bytes, bytes] = {}
        self.held = 0

    def _cut(self, text: str) -> list[str]:
        if self.whole.normalizer is not None:
            text = self.whole.normalizer.normalize_str(text)
        return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, word: str) -> list[str]:
        """A word, cut at the byte pairs that no token has inside."""
        joined, start, out = self.joined, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.old_words.get(word)
            if got is None:
                pieces = self.pieces(word)
                got = self._bytes([t.id for piece in pieces[:-1] for t in self.inner.tokenize(piece)] + [t.id for t in self.last.tokenize(pieces[-1])])
            self.words[word] = got
            self.held += len(word) + len(got) + ENTRY_BYTES
        return got

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.id_bytes[i] for i in ids])

    def _fragment(self, fragment: bytes) -> bytes:
        text = fragment.decode("utf-8")
        if b"<|" in fragment and any(s in text for s in self.special):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        if self.plain and fragment.isascii() and b"'" not in fragment and text.isprintable():
            words = self.ascii_words.findall(text.lower())
        else:
            words = self._cut(text)
        return self._word(words[0]) if len(words) == 1 else b"".join([self._word(w) for w in words])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text the ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if self.held > CACHE_BYTES // 2:
                self.old_ids, self.old_words, self.ids, self.words, self.held = self.ids, self.words, {}, {}, 0
            fragments = text.encode("utf-8").split()
            for x in set(fragments).difference(self.ids):
                got = self.old_ids.get(x)
                if got is None:
                    got = self._fragment(x)
                self.ids[x] = got
                self.held += len(x) + len(got) + ENTRY_BYTES
            out.append(b"".join(map(self.ids.__getitem__, fragments)))
        return out

    def decode(self, ids: bytes | None) -> str | None:
        """The library's decoding of ids, special tokens kept; null for what is no list of ids of tokens."""
        import numpy as np

        if ids is None or len(ids) % 4:
            return None
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            if self.token_of is None:
                return self.whole.decode(numbers, skip_special_tokens=False)
            return " ".join(map(self.token_of.__getitem__, numbers))
        except (KeyError, OverflowError):
            return None


_ENCODERS: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit).

    ``path`` is a tokenizer file that each executor can open. No shuffle: rows are encoded where they are read.
    """
    return _mapped(df, path, key, text, T.StructField("ids", T.BinaryType()))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` with ``decoded`` (string), from the ids that ``encode`` made. No shuffle."""
    import pyarrow as pa

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, "ids", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["key", "decoded"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("decoded", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with ``n_tokens``, ``ids`` and ``decoded``, the text that these ids decode to."""
    return _mapped(df, path, key, text, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()))


def encoded_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key`` with ``n_tokens``, ``ids`` if asked for, ``ids_sha256`` and ``decoded_sha256``: decoded texts are hashed where they are made."""
    own = [T.StructField("ids", T.BinaryType())] if ids else []
    return _mapped(df, path, key, text, *own, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()))


def _mapped(df: DataFrame, path: str, key: str, text: str, *fields: T.StructField) -> DataFrame:
    import pyarrow as pa

    kinds = {"ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        import hashlib

        enc = encoder(path)
        make = {
            "ids": lambda x: x,
            "decoded": enc.decode,
            "ids_sha256": lambda x: hashlib.sha256(x).hexdigest(),
            "decoded_sha256": lambda x: hashlib.sha256(enc.decode(x).encode("utf-8")).hexdigest(),
        }
        for batch in slices(batches, "text", 1 << 20):
            got = enc.encode_batch([x or "" for x in batch.column(1).to_pylist()])
            made = [pa.array([make[f.name](x) for x in got], kinds[f.name]) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), *made], names=["key", "n_tokens", *(f.name for f in fields)])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), *fields])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
