"""Token counts by the whole-token shortcut (operator 11).

Byte-level BPE encodes each pre-token for itself.  Before any text is read, every string of the
vocabulary is tried: those that the pre-tokeniser leaves whole and whose merges end in one token are
the proven ones.  A piece of a text that equals a proven string is one token and is only counted;
all other pieces are cut into pre-tokens, proven ones among them counted again, and merges run
on what is left.

The proof holds for tokenisers without normaliser, prefix space and dropout; for others
``WholeTokens`` is an error.  Truncation and padding of the file are switched off.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); texts of any length are read whole; repeated rows are counted each for itself; a null
``doc_id`` stays null; an empty table gives an empty table; other columns are not looked at, whatever their
names.  An added token's string in a text is that token, as the library has it by default.
Counts are exact, so there are no ties; a text of exactly ``limit`` tokens is not over it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, ship_package
from .byte_bpe import byte_characters
from .segments import SEGMENT


class WholeTokens:
    """Counts the tokens of texts for one tokeniser file.

    ``proven`` has the strings that are one token wherever they are a pre-token.  Counts of other short
    pieces are remembered, at most ``remembered`` of them, so memory stays bounded.
    """

    def __init__(self, path: str, remembered: int = 500_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("the shortcut is proven for byte-level BPE without normaliser, prefix space and dropout only")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens that look at what surrounds them are not supported")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        self.proven = self._prove()
        self.counts = dict.fromkeys(self.proven.values(), 1)
        self.room, self.longest, self.merged = remembered, longest, 0

    def _prove(self) -> dict[str, str]:
        """Byte-mapped vocabulary strings that encode alone as one token, with their texts."""
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        out = {}
        for mapped in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(byte_of[c] for c in mapped).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.added and self.added.search(text):
                continue
            if [p for p, _ in self.cut(text)] == [mapped] and len(self.merge(mapped)) == 1:
                out[mapped] = text
        return out

    def _piece(self, text: str) -> int:
        """Tokens of one piece that is not proven as a whole."""
        if self.added and self.added.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        n = 0
        for mapped, _ in self.cut(text):
            if mapped in self.proven:
                n += 1
            else:
                n += len(self.merge(mapped))
                self.merged += 1
        return n

    def __call__(self, text: str) -> int:
        pieces = SEGMENT.findall(text)
        found = list(map(self.counts.get, pieces))
        if None not in found:
            return sum(found)
        n = 0
        for piece, count in zip(pieces, found, strict=True):
            if count is None:
                count = self.counts.get(piece)
                if count is None:
                    count = self._piece(piece)
                    if len(piece) <= self.longest:
                        if self.room <= 0:
                            self.room += len(self.counts) - len(self.proven)
                            self.counts = dict.fromkeys(self.proven.values(), 1)
                        self.counts[piece] = count
                        self.room -= 1
            n += count
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> WholeTokens:
    """One counter, and one proof, for each worker process and file."""
    return WholeTokens(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; one pass, no shuffle."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def count(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(path)
        for texts in frames:
            yield texts.map(tokens).astype("int64")

    text = F.coalesce(docs["text"], F.lit(""))
    counted = docs.select(docs["doc_id"], F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
