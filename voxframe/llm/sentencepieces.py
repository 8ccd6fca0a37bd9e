"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; its normaliser, the metaspace mark, the piece scores (unigram) or the merges
they imply (BPE), and byte fallback are rebuilt for the backend, which encodes batches on several threads. The
original library is only used to verify parity, of every text: where no piece goes on past a mark, a text's ids are
those of its parts, so the original library's ids are compared for each part that a task meets, once, and its
normaliser's result for each whole text; where pieces do, whole texts are encoded by both.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from voxframe.llm.common import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Kinds of pieces and models in the public protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Texts of one call of the backend, in characters; bounds a worker's memory.
BATCH_CHARS = 400_000
THREADS = 2
PARTS = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
#: Parts of texts that a task remembers with their ids.
CACHE = 150_000


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


def parse_model(raw: bytes) -> dict:
    """pieces (text, score, kind), model kind, unknown id, byte fallback and the normaliser's settings."""
    out: dict = {"pieces": [], "kind": UNIGRAM, "bytes": False, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            out |= {"kind": spec.get(3, UNIGRAM), "bytes": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            out |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    out["unknown"] = next((i for i, p in enumerate(out["pieces"]) if p[2] == UNKNOWN), 0)
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that make each piece, best score first."""
    usable = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, (score, i) in usable.items():
        for k in range(1, len(piece)):
            if piece[:k] in usable and piece[k:] in usable:
                out.append((-score, i, usable[piece[:k]][1], usable[piece[k:]][1], piece[:k], piece[k:]))
    return [x[4:] for x in sorted(out)]


def parts_at_marks(spec: dict) -> bool:
    return not any(MARK in p.lstrip(MARK) or kind == USER for p, _, kind in spec["pieces"] if kind in (NORMAL, USER))


def build(spec: dict):  # noqa: ANN201
    """A tokenizers.Tokenizer of the same ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = spec["pieces"]
    if spec["kind"] == UNIGRAM:
        low = min(s for _, s, _ in pieces)
        scores = [(p, s if kind not in (CONTROL, UNUSED, BYTE) else low - 10) for p, s, kind in pieces]
        tok = Tokenizer(models.Unigram(scores, unk_id=spec["unknown"], byte_fallback=spec["bytes"]))
    elif spec["kind"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        tok = Tokenizer(models.BPE(vocab, merges_of(pieces), unk_token=pieces[spec["unknown"]][0], fuse_unk=True, byte_fallback=spec["bytes"]))
    else:
        raise ValueError(f"model kind {spec['kind']} is neither unigram nor BPE")
    steps = []
    if spec["charsmap"]:
        steps.append(normalizers.Precompiled(spec["charsmap"]))
    if spec["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec["prefix"] and not spec["suffix"]:
        steps.append(normalizers.Prepend(MARK))
    if spec["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    # Where no piece goes on past a mark after other characters, texts part there, and words can be remembered.
    if parts_at_marks(spec):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(PARTS), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec["prefix"] else [])])
    user = [AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER]
    if user:
        tok.add_tokens(user)
    return tok


class Codec:
    """Tokenizer of a model file with a bounded memory of the parts of texts it has met."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            self.spec = parse_model(f.read())
        self.tok = build(self.spec)
        self.bare = build(self.spec)  # for parts, which are normalised already
        if self.tok.normalizer is not None:
            from tokenizers import normalizers

            self.bare.normalizer = normalizers.Sequence([])
        self.parts = re.compile(PARTS) if parts_at_marks(self.spec) else None
        self.path = path
        self.met: dict[str, tuple[list[int], bool, bool]] = {}

    @cached_property
    def original(self):  # noqa: ANN201
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def agreed(self, parts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the original library gives each part the same ids. Its own prefix stands for a part's first mark."""
        prefix = self.spec["prefix"]
        shown = [p.replace(MARK, " ") for p in parts]
        theirs = self.original.encode([t[1:] if prefix and t[:1] == " " else t for t in shown], num_threads=1)
        x = self.original.encode("x")  # a lone prefix is no text, so marks alone are encoded after another word
        theirs = [self.original.encode("x" + t)[len(x) :] if not t.strip(" ") else i for i, t in zip(theirs, shown, strict=True)]
        return [i == x and (not prefix or t[:1] == " ") for i, x, t in zip(ids, theirs, shown, strict=True)]

    def _many(self, tok, texts: list[str]) -> Iterator[list[int]]:  # noqa: ANN001
        many = getattr(tok, "encode_batch_fast", tok.encode_batch)
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t) + 8
            if size > BATCH_CHARS:
                yield from (e.ids for e in many(part, add_special_tokens=False))
                part, size = [], 0
        yield from (e.ids for e in many(part, add_special_tokens=False))

    def encode(self, texts: list[str], verify: bool = False) -> list[tuple[list[int], bool, bool | None]]:
        """For each text its ids, whether decoding them gives it back, and (to verify) whether the original library agrees."""
        if self.parts is None:
            ids = list(self._many(self.tok, texts))
            back = self.tok.decode_batch(ids, skip_special_tokens=False)
            same = [i == x for i, x in zip(ids, self.original.encode(texts, num_threads=1), strict=True)] if verify else [None] * len(texts)
            return [(i, b == t, x) for i, b, t, x in zip(ids, back, texts, same, strict=True)]
        normal = [self.normal(t) if t else "" for t in texts]
        split = [self.parts.findall(t) for t in normal]
        if len(self.met) > CACHE:
            self.met.clear()
        met = self.met
        new = list({p for parts in split for p in parts if p not in met})
        if new:
            ids = list(self._many(self.bare, new))
            same = self.agreed(new, ids) if verify else [True] * len(new)
            plain = self.plain
            odd = []
            for p, i, x in zip(new, ids, same, strict=True):
                ok = "".join([plain[x] for x in i]) == p
                met[p] = i, ok, x
                if not ok:
                    odd.append(p)
            if odd:  # bytes: a filler before each part keeps the decoder from taking the first mark for the text's prefix
                for p, b in zip(odd, self.bare.decode_batch([self.filler + met[p][0] for p in odd], skip_special_tokens=False), strict=True):
                    met[p] = met[p][0], b[self.filler_chars :] == p.replace(MARK, " "), met[p][2]
        out = []
        for text, whole, parts in zip(texts, normal, split, strict=True):
            row: list[int] = []
            good = same = True
            for p in parts:
                i, ok, x = met[p]
                row += i
                good &= ok
                same &= x
            shown = whole.replace(MARK, " ")
            parity = (same and (not text or self.original.normalize(text) == whole)) if verify else None
            out.append((row, good and (shown[1:] if self.spec["prefix"] and shown[:1] == " " else shown) == text, parity))
        return out

    def normal(self, text: str) -> str:
        """The normaliser's result; where it only marks spaces, without a call of the backend."""
        spec = self.spec
        if self.tok.normalizer is None:
            return text
        if spec["charsmap"] or spec["squeeze"] or not (spec["prefix"] and spec["escape"]) or spec["suffix"]:
            return self.tok.normalizer.normalize_str(text)
        return MARK + text.replace(" ", MARK)

    @cached_property
    def plain(self) -> list[str]:
        return [p if kind in (NORMAL, USER) else "\0" for p, _, kind in self.spec["pieces"]]

    @cached_property
    def filler(self) -> list[int]:
        return self.bare.encode("x" + MARK, add_special_tokens=False).ids

    @cached_property
    def filler_chars(self) -> int:
        return len(self.bare.decode(self.filler))


_LOADED: dict[str, Codec] = {}


def load(path: str) -> Codec:
    """Codec of a model file, once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_texts(texts: list[str], path: str = MODEL) -> list[list[int]]:
    return [ids for ids, _, _ in load(path).encode(texts)]


def decode_ids(ids: list[list[int]], path: str = MODEL) -> list[str]:
    return load(path).tok.decode_batch(ids, skip_special_tokens=False)


def forget() -> None:
    """Drops what workers remember of texts; the models stay."""
    for codec in _LOADED.values():
        codec.met.clear()


def _encode_rows(path: str, digests: bool, parity: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(_shipped(path))
        for part in batches:
            texts = [(t or "").encode("utf-8", "replace").decode() for t in part.column(1).to_pylist()]
            got = codec.encode(texts, parity)
            ids = [x[0] for x in got]
            if not digests:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                continue
            marks = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(marks, pa.string()), pa.array([x[1] for x in got]), pa.array([x[2] for x in got], pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"],
            )

    return rows


def _ship(df: DataFrame, path: str) -> None:
    """Gives the model file to the executors, whose disks may not have it."""
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, path) not in _SENT:
        sc.addFile(path)
        _SENT.add((sc.applicationId, path))


_SENT: set[tuple[str, str]] = set()


def _shipped(path: str) -> str:
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids of each row of docs. Null texts give no ids; rows alike get equal ids; an empty table gives an empty result; other columns are not looked at."""
    _ship(docs, path)
    return in_batches(docs.select("doc_id", "text"), _encode_rows(path, False, False), "doc_id long, ids array<int>", forget)


def encoding_digests(docs: DataFrame, path: str = MODEL, parity: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip (the decoded ids are the text), parity of each row of docs.

    parity says whether the original library gives the text the same ids; it is null without `parity`. Null texts are
    empty and have no ids; rows alike get rows alike; an empty table gives an empty result; other columns are not
    looked at.
    """
    _ship(docs, path)
    return in_batches(docs.select("doc_id", "text"), _encode_rows(path, True, parity), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean", forget)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids). Null and empty ids give an empty text; no rows give no rows; repeated rows repeat."""
    _ship(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decode_ids(ids, _shipped(path)), pa.string())], names=["doc_id", "text"])

    return in_batches(rows.select("doc_id", "ids"), run, "doc_id long, text string")
