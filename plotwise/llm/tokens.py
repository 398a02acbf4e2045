"""Token counts and ids as the public tokenizer libraries give them."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, picked

#: Fixed value: how the lower-casing tokenizer cuts a text into pre-tokens.
WORD_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of which all Unicode versions say the same: letters (with their lower case), digits, white space or neither, and their own NFC.
LETTERS, OTHERS = "A-Za-zÀ-ÖØ-öø-įı-ȹȻ-Ƚȿ-ʯ", "!-/:-@[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧€"
UNUSUAL = rf"[^\t-\r 0-9{LETTERS}{OTHERS}]"


#: The pre-tokens of usual characters that are no runs of letters, in the order of ``WORD_PRE_TOKENS``.
MARKS = rf"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r 0-9{LETTERS}]+"


def byte_letters() -> dict[int, str]:
    """str.translate table from a byte to the letter that byte-level vocabularies write for it.

    Fixed values: printable bytes of Latin-1 stand for themselves; the others, in order, for the code points from 256.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b if b in own else 256 + rest.index(b)) for b in range(256)}


BYTE_LETTERS = "".join(letter for _, letter in sorted(byte_letters().items()))


def spelled(pre_token: str) -> str:
    return codecs.charmap_decode(pre_token.encode(), "strict", BYTE_LETTERS)[0]


def whole_tokens(file: str) -> dict[str, str]:
    """Vocabulary strings proved to encode alone, as one pre-token, to their one token (checked with the library itself), each with the vocabulary's spelling."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    ids, cut = list(names), tokenizer.pre_tokenizer.pre_tokenize_str
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    alone = [(i, t) for i, t in zip(ids, texts, strict=True) if t and "�" not in t and [p for p, _ in cut(t)] == [names[i]]]
    codes = tokenizer.encode_batch([t for _, t in alone], add_special_tokens=False)
    return {t: names[i] for (i, t), code in zip(alone, codes, strict=True) if code.ids == [i]}


#: A space between two characters that are no white space: a byte-level pre-token always begins there.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Remembered(dict):
    """What :meth:`made` gives for a string; holds ``most`` short ones at most besides ``always`` and then starts again."""

    def __init__(self, always: dict, made, most: int = 400_000, longest: int = 64):
        super().__init__(always)
        self.always, self.made, self.most, self.longest = always, made, most + len(always), longest

    def __missing__(self, text: str):
        out = self.made(text)
        if len(text) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.always)
            self[text] = out
        return out


class Counts:
    """Tokens of texts under a byte-level BPE tokenizer: 1 for a proved whole token; only other pre-tokens are merged.

    Pre-tokens are the library's own, of any script: texts are cut at lone spaces, and a piece that was seen before
    needs no cutting.
    """

    def __init__(self, file: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(file)
        merge, cut = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        counts = Remembered(dict.fromkeys(whole, 1), lambda pre_token: len(merge(pre_token)))
        self.first = Remembered({}, lambda piece: sum(counts[p] for p, _ in cut(piece)))
        self.spaced = Remembered({}, lambda piece: sum(counts[p] for p, _ in cut(" " + piece)))

    def of(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = LONE_SPACE.split(text)
        return self.first[first] + sum(map(self.spaced.__getitem__, rest))


class Ids:
    """Ids (little-endian, unsigned 32 bits) of texts under a lower-casing BPE tokenizer that drops white space.

    Texts of characters that the ranges above cover are cut here, a run of them at once, and each distinct pre-token of
    a run is looked up once; other texts are the library's. Both give the library's ids.
    """

    def __init__(self, file: str, run_bytes: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.run_bytes = Tokenizer.from_str(file), run_bytes
        merge, self.special = self.tokenizer.model.tokenize, [t["content"] for t in json.loads(file)["added_tokens"]]
        self.known = Remembered({}, lambda pre_token: array("I", [t.id for t in merge(spelled(pre_token))]).tobytes())

    def of(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text, in order; null is empty. Runs have about ``run_bytes`` of text (a longer text more)."""
        texts = texts.fill_null("")
        runs = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // self.run_bytes
        for first, end in pairwise([0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]):
            yield from self.of_run(texts.slice(first, end - first).cast(pa.large_string()))

    def of_run(self, texts: pa.LargeStringArray) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, UNUSUAL)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.filter(pc.invert(whole))), MARKS, r" \0 "))
        places = cut.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(places.dictionary)], places.dictionary), pa.scalar(" ", pa.large_string()))
        ids = [self.known[p] for p in distinct[0].as_py().split(" ")]  # to_pylist takes seven times as long
        sizes, indices = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, places.indices.to_numpy()
        each, firsts = sizes[indices], np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(each)])
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(firsts[indices] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        own = pairwise((4 * ends[cut.offsets.to_numpy()]).tolist())
        for i, library in enumerate(whole.to_pylist()):
            if library:
                yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                first, end = next(own)
                yield out[first:end]


def tokenizer_file(path: str, normalizer, pre_tokenizer) -> str:
    """The content of ``path``, if it is of the kind asked for; it travels with the tasks, which need no such file."""
    with open(path, encoding="utf-8") as f:
        spec = json.loads(file := f.read())
    if spec["normalizer"] != normalizer or spec["pre_tokenizer"] != pre_tokenizer or any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path} is a tokenizer of another kind")
    return file


def byte_bpe_file(path: str) -> str:
    return tokenizer_file(path, None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def word_bpe_file(path: str) -> str:
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = [{"type": "Split", "pattern": {"Regex": WORD_PRE_TOKENS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return tokenizer_file(path, {"type": "Sequence", "normalizers": normal}, {"type": "Sequence", "pretokenizers": cuts})


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id n_bytes n_tokens over_limit`` for every row of ``docs``, by the whole-token shortcut.

    ``tokenizer_path``: JSON of a byte-level BPE tokenizer without normaliser. Counts are those of the library without
    added special tokens; special strings inside a text are cut out first, as the library does, and count one each.
    Null text is empty (0 tokens). Rows are independent: repeated rows repeat, an empty table gives an empty result,
    other columns are not read. There is no shuffle; a worker remembers a bounded number of merged pre-tokens.
    """
    file = byte_bpe_file(tokenizer_path)
    special = sorted((t["content"] for t in json.loads(file)["added_tokens"]), key=len, reverse=True)
    model, name = docs.sparkSession.sparkContext.broadcast((file, frozenset(whole_tokens(file).values()))), zlib.crc32(file.encode())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(("counts", name), lambda: Counts(*model.value))
        cut = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                parts = cut.split(text)
                counts.append(len(parts) - 1 + sum(map(known.of, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
