"""Words of whole batches of texts as numbers, and their subword ids, for operators that run on Arrow batches.

A word is a run without ASCII white space. A batch is split and its words numbered by Arrow; only different words
are tokenised, and their ids are gathered by number. All of it goes on in short steps, so that of a batch just its word
numbers and different words with their ids are held, and anything wider for one step only.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22  # text taken at a time; a longer text is a slice of its own
SPLIT_BYTES = 1 << 20  # text split at a time within a slice
STEP_WORDS = 1 << 13  # different words tokenised at a time
STEP_IDS = 1 << 16  # words whose ids are gathered at a time


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> list[pa.Array]:
    """A batch in parts of bounded size, in order."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    parts = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)] if len(texts) else [0]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def numbered(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cumulative number of words per text (first 0), number of each word, and the different words.

    ``lower``: A-Z are lower-cased. NULL counts as empty.
    """
    ends, coded, seen = [np.zeros(1, "int64")], [], 0
    for part in slices(texts, SPLIT_BYTES):
        filled = pc.fill_null(part, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(filled) if lower else filled)
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(np.asarray(real.to_numpy(zero_copy_only=False), dtype=bool))])
        ends.append(seen + before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()])
        seen += int(before[-1])
        coded.append(pc.dictionary_encode(flat.filter(real)))
    if not coded:
        return ends[0], np.zeros(0, "int32"), texts.slice(0, 0)
    pa.default_memory_pool().release_unused()  # what splitting took goes back to the system
    # Words keep the order of their first appearance.
    parts = pa.chunked_array(coded).unify_dictionaries().chunks
    return np.concatenate(ends), np.concatenate([p.indices.to_numpy() for p in parts]), parts[0].dictionary


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters and marks whose subwords don't depend on anything around them: after lower-casing, each run of letters and
#: each run of marks is tokenised by itself.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: Bytes that byte-level vocabularies write as characters from 256 onwards, in order; others stand for themselves.
UNPRINTED = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _runs(runs: list[str], path: str) -> list[list[int]]:
    """Ids of runs of letters or marks, each by one call of the vocabulary's model."""
    tokenize = tokenizer(path).model.tokenize
    return [
        [t.id for t in tokenize(r if r.isascii() else r.encode().decode("latin-1").translate(UNPRINTED))] if r else [] for r in runs]


def _any(words: list[str], path: str) -> list[list[int]]:
    """Ids of any words: they are encoded as one text with spaces between, and offsets tell which word an id belongs to."""
    if not words:
        return []
    coded = tokenizer(path).encode(" ".join(words), add_special_tokens=False)
    ends = np.cumsum([len(w) + 1 for w in words])
    owner = np.searchsorted(ends, [a for a, _ in coded.offsets], side="right")
    cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
    ids = coded.ids
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _in_steps(tokenize, words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after another, and how many each has, by some words at a time."""
    ids, lengths = [np.zeros(0, "uint32")], [np.zeros(0, "int64")]
    for start in range(0, len(words), STEP_WORDS):
        found = tokenize(words.slice(start, STEP_WORDS).to_pylist(), path)
        lengths.append(np.fromiter(map(len, found), "int64", len(found)))
        ids.append(np.fromiter((i for own in found for i in own), "uint32", int(lengths[-1].sum())))
    return np.concatenate(ids), np.concatenate(lengths)


def subwords(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words one after another, and where each word's ids start (one entry more than words).

    For vocabularies of lower-cased, byte-level word pieces, like the public ``word_bpe``.
    """
    found = pc.extract_regex(words, pattern=PLAIN)
    plain = np.asarray(found.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    letters = pc.dictionary_encode(pc.utf8_lower(found.field("letters").filter(pa.array(plain))))
    marks = pc.dictionary_encode(found.field("marks").filter(pa.array(plain)))
    groups = [
        _in_steps(_runs, letters.dictionary, path), _in_steps(_runs, marks.dictionary, path),
        _in_steps(_any, words.filter(pa.array(~plain)), path)]
    flat, lengths = np.concatenate([ids for ids, _ in groups]), np.concatenate([*(n for _, n in groups), [0]])
    starts = np.concatenate([[0], np.cumsum(lengths, dtype="int64")])
    first_mark, first_other = len(groups[0][1]), len(groups[0][1]) + len(groups[1][1])
    parts = np.full((len(words), 2), len(lengths) - 1)  # the last part is empty
    parts[plain, 0] = letters.indices.to_numpy()
    parts[plain, 1] = first_mark + marks.indices.to_numpy()
    parts[~plain, 0] = first_other + np.arange(int((~plain).sum()))
    ids, after = gathered(flat, starts, parts.reshape(-1))
    return ids, after[::2].copy()


def gathered(ids: np.ndarray, starts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of words, and the cumulative number of ids after each of them (first 0)."""
    ends = np.zeros(len(word) + 1, "int64")
    np.cumsum((starts[1:] - starts[:-1])[word], out=ends[1:])
    out = np.empty(ends[-1], ids.dtype)
    for a in range(0, len(word), STEP_IDS):
        own = word[a:a + STEP_IDS]
        cuts = ends[a:a + len(own) + 1]
        out[cuts[0]:cuts[-1]] = ids[np.arange(cuts[0], cuts[-1]) + np.repeat(starts[own] - cuts[:-1], np.diff(cuts))]
    return out, ends
