"""Token ids of texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and parts of words that an encoder remembers, about; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Bytes of text that are encoded at one time, and pieces whose ids are gathered at one time.
SLICE, GATHER = 8 << 20, 1 << 18
#: Lower-case letters that are the same in all Unicode versions and stay as they are when normalised; and ASCII without letters.
LETTERS, OTHERS = "a-zß-öø-ÿ", r"!-@\[-`{-~"
WHOLE = f"^[{LETTERS}{OTHERS}]+$"
#: An apostrophe before a letter may be the beginning of a token with it, and special tokens begin with these marks.
JOINED = f"'[{LETTERS}]|<[|]"
#: The characters whose capitals have one lower-case letter each.
PLAIN = "^[\u0001-\u012f]*$"


def gather(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of store that begin at starts and have these sizes, one after another."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), store.dtype)
    for low in range(0, len(sizes), GATHER):
        high = min(low + GATHER, len(sizes))
        a, b = int(ends[low]), int(ends[high])
        out[a:b] = store[np.repeat(starts[low:high] - ends[low:high], sizes[low:high]) + np.arange(a, b)]
    return out


class Encoder:
    """Encodes whole texts, word by word where the tokenizer drops the white space between words.

    Such a tokenizer never joins characters across ASCII white space, nor letters with marks or digits but for
    an apostrophe before a letter. The ids of a text are then those of its words in turn, and the ids of a
    word those of its runs of letters and of other characters; a word or run met before needs no work. It
    lower-cases, too, so words are remembered in lower case, unless the text may hold a special token.
    Other tokenizers encode each text at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = drops_gaps(path)
        self.of_letters = Tokenizer.from_str(letters_only(path)) if self.by_words else None
        self.run_ends = run_ends(self.tokenizer, path) if self.by_words else None
        self.forget()

    def forget(self) -> None:
        """Only the empty word is known."""
        self.words, self.store, self.sizes = pa.array([""]), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        return self.flat(pa.array([text], pa.string()))[0]

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with end_id behind it if there is one, and where each text ends."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            parts = [np.array(ids if end_id is None else [*ids, end_id], np.uint32) for ids in found]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64)
        marked = pc.match_substring(texts, "<|")
        words = pc.ascii_split_whitespace(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = words.flatten().dictionary_encode()
        place = self.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        store, sizes = self.store, self.sizes
        if end_id is not None:  # one more word behind each text
            place = np.insert(place, offsets[1:], len(sizes))
            store, sizes = np.append(store, np.uint32(end_id)), np.append(sizes, 1)
            offsets = offsets + np.arange(len(offsets))
        size = sizes[place]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets[1:]]
        return gather(store, (np.cumsum(sizes) - sizes)[place], size), ends

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each of these distinct words among the known ones; new ones are learnt in one go."""
        if len(self.words) > REMEMBERED:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        new = pc.is_null(at)
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            out[new.to_numpy(zero_copy_only=False)] = self.learn(words.filter(new))
        return out

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remembers distinct words; their places."""
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.store, self.sizes = np.concatenate([self.store, ids]), np.concatenate([self.sizes, sizes])
        return np.arange(first, len(self.words))

    def learn(self, words: pa.Array) -> np.ndarray:
        """Remembers words that are not known, and their runs; their places."""
        low = pc.if_else(pc.match_substring_regex(words, PLAIN), pc.utf8_lower(words), words)
        split = pc.and_(pc.match_substring_regex(low, WHOLE), pc.invert(pc.match_substring_regex(low, JOINED)))
        runs = pc.split_pattern(pc.replace_substring_regex(low.filter(split), f"([{LETTERS}]+)", "\x1f\\1\x1f"), "\x1f")
        coded = runs.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        unknown, letters = pc.is_null(at), pc.match_substring_regex(coded.dictionary, f"^[{LETTERS}]")
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for chosen, encode in ((pc.and_(unknown, letters), self.of_runs), (pc.and_not(unknown, letters), self.one_by_one)):
            new = coded.dictionary.filter(chosen)
            place[chosen.to_numpy(zero_copy_only=False)] = self.add(new, *encode(new.to_pylist()))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        of_word = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        # a word that is one run, as it stands, has the place of the run; the others get their own
        out = np.bincount(of_word, place, len(runs)).astype(np.int64)
        several = (np.bincount(of_word, place > 0, len(runs)) > 1) | pc.not_equal(low.filter(split), words.filter(split)).to_numpy(zero_copy_only=False)
        sizes = np.bincount(of_word, self.sizes[place], len(runs)).astype(np.int64)
        inside = place[several[of_word]]
        ids = gather(self.store, (np.cumsum(self.sizes) - self.sizes)[inside], self.sizes[inside])
        out[several] = self.add(words.filter(split).filter(pa.array(several)), ids, sizes[several])
        places, apart = np.empty(len(words), np.int64), split.to_numpy(zero_copy_only=False)
        whole = words.filter(pc.invert(split))
        places[apart], places[~apart] = out, self.add(whole, *self.one_by_one(whole.to_pylist()))
        return places

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def of_runs(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of letters, by the same model without its first steps, which leave such runs as they are."""
        if not letters or self.run_ends is None:
            return self.one_by_one(letters)
        ids = np.array(self.of_letters.encode_batch_fast([letters], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.run_ends[ids]) + 1, prepend=0)


def run_ends(tokenizer, path: str) -> np.ndarray | None:
    """Which ids end a run, for models that mark the end of each."""
    with open(path, encoding="utf-8") as f:
        mark = (json.load(f).get("model") or {}).get("end_of_word_suffix")
    if not mark:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
    return out


def letters_only(path: str) -> str:
    """The tokenizer without normalisation and without splitting."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    steps = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
    return json.dumps(whole | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps} if steps else None})


def drops_gaps(path: str) -> bool:
    """Whether the tokenizer lower-cases, splits a text into runs without white space and drops all else."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    first = whole.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    parts = ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+")
    rest = pattern.split("|")
    steps = whole.get("normalizer") or {}
    lowers = any(n.get("type") == "Lowercase" for n in steps.get("normalizers", [steps]))
    return lowers and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and all(p in parts or (p.startswith("'") and p[1:].isalpha()) for p in rest)


def in_slices(encoder: Encoder, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of about SLICE bytes of an Arrow column of texts: its first row, its ids and where each text ends in them."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(column):
        before = int(sizes[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + SLICE)))
        yield low, *encoder.flat(column.slice(low, high - low), end_id)
        low = high


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python process."""
    return Encoder(path)
