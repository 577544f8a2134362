"""Token counts of whole texts with a whole-token shortcut.

Ahead of the job, every vocabulary string is proved or not to encode alone as one token. A task then cuts
its texts into the library's pre-tokens: those of the proved strings count one each, and only the others
are merged by the library, each distinct one once per worker while its bounded table holds it. Texts with
characters outside the range on which the pre-token pattern is proved equal, or with an added token, are
encoded whole by the library.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null key and repeated rows are kept;
an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices

TABLE_LIMIT = 400_000
#: White space, letters and numbers among the code points up to U+024F.
_BLANK = "\t-\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: The byte-level pre-token pattern of the library, spelled out for that range.
PRE_TOKEN = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
BEYOND = "[^\\x00-\\x{24F}]"


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark hands out the cores
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode, alone, as one token."""
    library = _library(path)
    ids = range(library.get_vocab_size(with_added_tokens=False))
    texts = [t for t in library.decode_batch([[i] for i in ids], skip_special_tokens=False) if t and "�" not in t]
    one = [t for t in set(texts) if PRE_TOKEN.fullmatch(t) and max(t) <= "ɏ"]
    return [t for t, e in zip(one, library.encode_batch(one, add_special_tokens=False), strict=True) if len(e.ids) == 1]


class Counter:
    """``count(texts)`` for one vocabulary; ``proved`` are its whole tokens."""

    def __init__(self, path: str, proved: list[str]):
        self.library = _library(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([BEYOND, *added])
        self.proved = dict.fromkeys(proved, 0)
        self.extra = dict(self.proved)  # tokens beyond the first of each pre-token

    def count(self, texts: pa.Array) -> list[int]:
        if len(self.extra) > TABLE_LIMIT:
            self.extra = dict(self.proved)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_pylist()
        plain = texts.to_pylist()
        parts = [[] if o else PRE_TOKEN.findall(t) for t, o in zip(plain, odd, strict=True)]
        new = list(set(chain.from_iterable(parts)) - self.extra.keys())
        encoded = self.library.encode_batch_fast(new, add_special_tokens=False)
        extra = self.extra
        extra.update((p, len(e.ids) - 1) for p, e in zip(new, encoded, strict=True))
        return [
            len(self.library.encode(t, add_special_tokens=False).ids) if o else len(p) + sum(map(extra.__getitem__, p))
            for t, o, p in zip(plain, odd, parts, strict=True)
        ]


class PieceCounter:
    """The same for a sentencepiece model, which merges across blanks: texts are encoded whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: pa.Array) -> list[int]:
        return [len(x) for x in self.library.encode([t or "" for t in texts.to_pylist()], num_threads=1)]


_COUNTERS: dict[str, Counter | PieceCounter] = {}


def counter_for(tokenizer: str, proved) -> Counter | PieceCounter:
    """One counter per worker and vocabulary; ``proved`` is a broadcast of the whole tokens, or None."""
    if tokenizer not in _COUNTERS:
        _COUNTERS[tokenizer] = PieceCounter(tokenizer) if proved is None else Counter(tokenizer, proved.value)
    return _COUNTERS[tokenizer]


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``key, n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row."""
    source = df.select(key, df[text].cast("string").alias("_text"))
    kind = source.schema[key].dataType.simpleString()
    # The whole tokens are at most the vocabulary, whatever the corpus.
    proved = None if tokenizer.endswith(".model") else df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer, proved)
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            n = pa.array(counter.count(texts), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
