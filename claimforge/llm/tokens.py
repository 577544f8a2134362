"""Token ids of whole texts, exactly as the tokenizers library gives them, in less than half its time.

A word tokenizer that drops white space treats every white-space-free chunk alone. So a batch of texts
is split, each distinct run of letters and each distinct other chunk is encoded once by the library, and
the ids are laid out by index. Between batches only the ids of so many runs are kept (``KNOWN_RUNS``).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spaces beyond the usual six, on which the libraries' definitions could differ: such texts are encoded whole.
_ODD_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"
#: Letters up to U+017F whose lower case is one letter and which compose with no ASCII punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_ALL_LETTERS = "".join(filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(0x180))))
#: Runs of letters whose ids an encoder keeps; it decides time, never results.
KNOWN_RUNS = 1 << 19
_PUNCT = ".,;:!?()[]\"*#$%&|<>-"


class Parts:
    """Runs of ids laid end to end; part ``i`` is ``ids[firsts[i] : firsts[i] + sizes[i]]``."""

    def __init__(self, ids: list[np.ndarray], sizes: list[np.ndarray]):
        self.ids = np.concatenate([*ids, np.zeros(0, "<u4")]).astype("<u4")
        self.sizes = np.concatenate([*sizes, np.zeros(1, np.int64)]).astype(np.int64)  # the last part is empty
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def lay(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of ``index`` one after another, and where each ends (0 first)."""
        counts = self.sizes[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.repeat(self.firsts[index] - ends[:-1], counts) + np.arange(ends[-1])], ends


class WordEncoder:
    """``encode(texts)``: ids of all texts in one array, and where each text starts in it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD_SPACE, *map(re.escape, added)])
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.known, self.known_ids, self.known_sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts the library encodes one by one, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def runs(self, letters: pa.Array, width: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters: each is one word of the library, whose last id alone ends a word."""
        bounds = np.append(np.arange(0, len(letters), width), len(letters)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), letters), " ").to_pylist()
        found = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, "<u4")])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(letters):
            return self.each(letters.to_pylist())
        return ids, np.diff(np.concatenate([[0], ends]))

    def runs_once(self, letters: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Where each run stands among the parts of the ids and sizes returned; runs known from before are not encoded again."""
        at = pc.fill_null(pc.index_in(letters, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        fresh = letters.filter(pa.array(at < 0))
        ids, sizes = self.runs(fresh)
        places = np.where(at < 0, len(self.known) + np.cumsum(at < 0) - 1, at)
        found = places, [self.known_ids, ids], [self.known_sizes, sizes]
        room = min(KNOWN_RUNS - len(self.known), len(fresh))
        if room > 0:
            self.known = pa.concat_arrays([self.known, fresh[:room]])
            self.known_ids = np.concatenate([self.known_ids, ids[: sizes[:room].sum()]])
            self.known_sizes = np.concatenate([self.known_sizes, sizes[:room]])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nulls count as empty. The second array has one entry more than there are texts."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        core = pc.utf8_rtrim(chunks, _PUNCT)
        plain = pc.match_substring_regex(core, f"^[{_LETTERS}]+$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        tails = pc.utf8_ltrim(chunks.filter(plain), _ALL_LETTERS).dictionary_encode()
        whole = [*tails.dictionary.to_pylist(), *chunks.filter(pc.invert(plain)).to_pylist(), *texts.filter(odd).to_pylist()]
        places, run_ids, run_sizes = self.runs_once(letters.dictionary.cast(pa.string()))
        other_ids, other_sizes = self.each(whole)
        parts = Parts([*run_ids, other_ids], [*run_sizes, other_sizes])
        empty, n_tails = len(parts.sizes) - 1, len(tails.dictionary)
        n_runs = empty - len(whole)
        # Every chunk is two parts: letters and what follows them, or the whole and nothing; so is a text encoded whole.
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        two = np.full((len(chunks) + len(odd_at), 2), empty, np.int64)
        is_run = np.append(is_plain, np.zeros(len(odd_at), bool))
        two[is_run, 0] = places[letters.indices.to_numpy(zero_copy_only=False)]
        two[is_run, 1] = n_runs + tails.indices.to_numpy(zero_copy_only=False)
        two[~is_run, 0] = np.arange(n_runs + n_tails, empty)
        each_ids, each_ends = parts.lay(two.reshape(-1))
        order, offsets = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if len(odd_at):  # a text encoded whole stands where its (empty) chunks do
            order = np.insert(order, offsets[odd_at], len(chunks) + np.arange(len(odd_at)))
            extra = np.zeros(len(offsets), np.int64)
            extra[odd_at + 1] = 1
            offsets = offsets + np.cumsum(extra)
        ids, ends = Parts([each_ids], [np.diff(each_ends[::2])]).lay(order)
        return ids, ends[offsets]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark hands out the cores
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
