"""Sub-word encoding in Arrow batches; the vocabulary's file is a parameter, loaded once by each Python worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks of the chat template; as tokens of their own they take the ids after the vocabulary's.
MARKS = ("<s>", "</s>", "<unk>", "<pad>", "<|conv|>", "<|turn|>", "<|end|>")
#: One of the owner's turns: its reply and the mark that closes it.
OWNER_TURN = re.compile(f"{re.escape(MARKS[5] + 'ME:')}(.*?)({re.escape(MARKS[6])})", re.DOTALL)


@lru_cache(8)
def load(path: str, marks: tuple[str, ...] = ()):
    """The vocabulary with each mark as one token. Marks aren't special: decoding keeps them, and special tokens of the file stay plain text."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    if marks:
        t.add_tokens([AddedToken(m, special=False, normalized=False) for m in marks])
    return t


def _worker(path: str, marks: tuple[str, ...]):
    """load() for a Python worker: its task has one core, and each thread of the library's own keeps memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return load(path, marks)


def mark_ids(path: str = TOKENIZER, marks: tuple[str, ...] = MARKS) -> dict[str, int]:
    t = load(path, marks)
    return {m: t.token_to_id(m) for m in marks}


def saved(path: str, out: str, marks: tuple[str, ...] = MARKS) -> None:
    """Writes the vocabulary with its marks as one file, which load() reads without being told of them."""
    load(path, marks).save(out)


def demoted(text: str, tokens: set[str]) -> str:
    """A vocabulary file's JSON whose added tokens no longer hold these: they stay in the model's vocabulary, and decoding doesn't skip them."""
    held = json.loads(text)
    if "added_tokens" in held:
        held["added_tokens"] = list(filter(lambda added: added["content"] not in tokens, held["added_tokens"]))
    return json.dumps(held, ensure_ascii=False)


def answer_ids(letters: list[str], cue: str, path: str = TOKENIZER) -> list[int]:
    """The first token that a letter adds after the cue and a blank: what a model would give out there, which isn't the letter's own id. An error if the cue's tokens change with it."""
    encode_ = lambda x: load(path).encode(x, add_special_tokens=False).ids
    start, out = encode_(cue), []
    for letter in letters:
        ids = encode_(f"{cue} {letter}")
        if len(ids) == len(start) or ids[: len(start)] != start:
            raise ValueError(f"{letter!r} changes the tokens of the cue before it")
        out.append(ids[len(start)])
    return out


def encode(c: Column, path: str = TOKENIZER, marks: tuple[str, ...] = ()) -> Column:
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            found = _worker(path, marks).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            yield pa.array([None if t is None else e.ids for e, t in zip(found, texts)], pa.list_(pa.int32()))

    return run(c)


def encode_with_offsets(c: Column, path: str = TOKENIZER, marks: tuple[str, ...] = ()) -> Column:
    """Ids and the characters [a, b) that each stands for."""

    @F.arrow_udf("ids array<int>, a array<int>, b array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            found = _worker(path, marks).encode_batch([t or "" for t in texts], add_special_tokens=False)
            offsets = [e.offsets for e in found]
            lists = [e.ids for e in found], [[x for x, _ in o] for o in offsets], [[y for _, y in o] for o in offsets]
            yield pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in lists], ["ids", "a", "b"])

    return run(c)


def decode(ids: Column, path: str = TOKENIZER, marks: tuple[str, ...] = ()) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in slices(batches):
            yield pa.array(_worker(path, marks).decode_batch([x or [] for x in ids], skip_special_tokens=False), pa.string())

    return run(ids)


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_pieces(c: Column, path: str = PIECES) -> Column:
    """Ids by a vocabulary of pieces over the compatibility normal form, with blanks as marks and bytes for what it lacks."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            found = _pieces(path).encode([t or "" for t in texts], num_threads=1)
            yield pa.array([None if t is None else ids for ids, t in zip(found, texts)], pa.list_(pa.int32()))

    return run(c)


def count_pieces(c: Column, path: str = PIECES) -> Column:
    """As many ids as encode_pieces gives, without giving them out."""

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            found = _pieces(path).encode([t or "" for t in texts], num_threads=1)
            yield pa.array([None if t is None else len(ids) for ids, t in zip(found, texts)], pa.int32())

    return run(c)


def owner_spans(c: Column) -> Column:
    """Characters [a, b) of each of the owner's replies, from behind its label to the end of its closing mark, in a rendered conversation."""

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            found = [[{"a": m.start(1), "b": m.end(2)} for m in OWNER_TURN.finditer(t or "")] for t in texts]
            yield pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    return run(c)


def within(spans: Column, encoded: Column) -> Column:
    """A flag for each token: 1 if it lies in one of the spans and isn't empty."""
    pairs = F.arrays_zip(encoded["a"].alias("a"), encoded["b"].alias("b"))
    return F.transform(pairs, lambda t: (F.exists(spans, lambda s: (t["a"] >= s["a"]) & (t["b"] <= s["b"])) & (t["b"] > t["a"])).cast("int"))
