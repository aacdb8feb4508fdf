"""Token ids and token counts of public tokenizers, with the cost of each distinct word paid once.

``word_encoder`` gives the ids of word_bpe_49k.json. Words separated by white space encode
alone, since no token spans white space, so ids are looked up word by word; a new word goes
through a byte-pair encoder built from the same merges. In it the end-of-word mark is a trailing
space: the vocabulary's first merges (ids 256 to 511) then join every word's last byte with it,
which is what the mark means. Texts with characters outside the plain set, or with a special
string, go to the library as a whole.

``piece_counter`` counts the tokens of piece_bpe_32k.model. Its vocabulary shows that no token
has a space mark behind another character, so a text falls into pre-tokens (a run of marks and
what follows) that merge only inside themselves. Which vocabulary strings encode alone as one
token is proved against the library once per process, and a pre-token among them counts one
without any merging; the rest is merged, each distinct one once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import map_arrow, whole_text
from loomery.llm.words import Memo, blocks, coded, gather, sums

WORD_FILE, PIECE_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096

#: ASCII and the letters and quotes of western European prose. Within this set normal form C
#: changes nothing, lower case goes letter by letter, and the classes below equal the Unicode ones.
_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ¿¡«»“”‘’–—…€£°]")
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _word_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """words -> ids of each as little-endian 16-bit numbers, all merged in one call."""
    import tiktoken

    chars, mark = _printable_bytes(), "</w>"
    ranks, last = {}, np.zeros(1 << 16, bool)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    for token, i in vocab.items():
        if not token.startswith("<|"):
            body = token.removesuffix(mark)
            last[i] = body != token
            ranks[bytes(chars[c] for c in body) + b" " * (body != token)] = i
    encode = tiktoken.Encoding("word", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(words: list[str]) -> list[bytes]:
        pre = [_PRE.findall(w) for w in words]
        merged = np.array(encode(" ".join([*chain.from_iterable(pre), ""])), "<u2")
        ends = np.concatenate([[0], np.flatnonzero(last[merged]) + 1])[np.cumsum([0, *map(len, pre)])] * 2
        raw, ends = merged.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    return ids


@cache
def word_encoder(path: str | None = None) -> Callable[[pa.Array], list[np.ndarray]]:
    """texts -> ids of the word tokenizer for each, without added special tokens."""
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(WORD_FILE)
    memo, library = Memo(_word_ids(path)), Tokenizer.from_file(path)

    def encode(texts: pa.Array) -> list[np.ndarray]:
        plain = [t.as_py() for t in texts]
        odd = [i for i, t in enumerate(plain) if _ODD.search(t) or "oftext|>" in t]
        lower = [t.lower() for t in plain]
        for i in odd:
            lower[i] = ""
        codes, offsets, words = coded(pc.ascii_split_whitespace(pa.array(lower, pa.large_string())))
        n, ids = gather(memo(words), codes, "<u2")
        out = np.split(ids, np.cumsum(sums(n, offsets))[:-1])
        for i in odd:
            out[i] = np.array(library.encode(plain[i], add_special_tokens=False).ids, "<u4")
        return out

    return encode


_RUNS = re.compile(" {2,}")


def _proved(model) -> dict[str, int]:
    """Pre-tokens, without their first mark, that the library is seen to encode as one token."""
    special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a token has a space mark inside: texts can't be cut into pre-tokens")
    # The library itself puts a mark in front, so each string goes in without its first one.
    whole = [p[1:] for p in pieces if p[0] == "▁"]
    alone = model.encode([p.replace("▁", " ") for p in whole], num_threads=1)
    return {p: 1 for p, ids in zip(whole, alone) if len(ids) == 1} | {"": 1}


@cache
def piece_counter(path: str | None = None) -> Callable[[pa.Array], np.ndarray]:
    """texts -> number of tokens of the piece tokenizer in each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECE_FILE))
    # To the library a mark in a text is a space.
    memo = Memo(lambda pre: [len(x) for x in model.encode([p.replace("▁", " ") for p in pre], num_threads=1)], _proved(model))

    def marked(text: str) -> str:
        """The text in which each space but the first of a run is a mark, so that spaces separate pre-tokens."""
        return _RUNS.sub(lambda m: " " + "▁" * (len(m[0]) - 1), " " + text.replace("▁", " "))[1:]

    def count(texts: pa.Array) -> np.ndarray:
        codes, offsets, words = coded(pc.split_pattern(pa.array([marked(t.as_py()) for t in texts], pa.large_string()), " "))
        n = sums(np.array(memo(words), np.int64)[codes], offsets)
        n[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        return n

    return count


def token_counts(docs: DataFrame, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row and whole text.

    Null texts count as empty and have no tokens. Strings of special tokens are ordinary text, as
    the library's default has it. Rows are independent of each other: repeated ids give repeated
    rows, an empty table none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for b in batches:
            for first, end in blocks(b.column(2)):
                some = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(count(some.column(2)))], ["doc_id", "n_bytes", "n_tokens"]
                )

    text = whole_text(F.col(text_col))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = map_arrow(plain, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
