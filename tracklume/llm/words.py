"""Pre-tokens: the split of a text before any merge, and the frequent ones of a corpus."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import _stored

#: Fixed value: code points with the White_Space property.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Distinct pre-tokens that a task counts before it hands them on.
FLUSH = 1 << 19
#: Bounds of the frequent tier: pre-tokens, and bytes of each.
MOST_WORDS, MOST_BYTES = 1 << 19, 32


@cache
def _members(kind: str) -> frozenset[str]:
    r"""Characters of \p{L} or \p{N} as the tokenizer library reads them, whatever its Unicode version: it is asked once."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    asked = tiktoken.Encoding(f"class_{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return frozenset(bytes(asked.encode_ordinary(every)).decode())


def _spans(chars) -> str:
    """A character class's inside as ranges."""
    out, points = [], sorted(map(ord, chars))
    first = last = None
    for c in [*points, None]:
        if last is not None and c != last + 1:
            out.append(re.escape(chr(first)) + ("-" + re.escape(chr(last)) if last > first else ""))
        if last is None or c != last + 1:
            first = c
        last = c
    return "".join(out)


def standard(pattern: str) -> str:
    r"""A pattern with \p{L}, \p{N}, \s and \S as one that Python's re reads alike."""
    inside = {r"\p{L}": _spans(_members("L")), r"\p{N}": _spans(_members("N")), r"\s": WHITE}
    out, bracket, i = [], False, 0
    while i < len(pattern):
        for name, chars in inside.items():
            if pattern.startswith(name, i):
                out.append(chars if bracket else f"[{chars}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{WHITE}]")
                i += 2
                continue
            c = pattern[i]
            bracket = (bracket or c == "[") and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


def quick(pattern: str) -> str | None:
    r"""The pattern in Python's own classes, several times as fast.  It splits a text alike unless the text has
    a character of :func:`odd`: a number that is no digit counts as a letter there, and some controls as white space.
    """
    parts = pattern.split("|")
    if (words := r" ?\p{L}+") in parts and all(x.startswith("'") for x in parts[: parts.index(words)]):
        parts.remove(words)  # no contraction begins like a word, so words may be tried first
        pattern = "|".join([words, *parts])
    out = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
    if re.search(r"\[[^\]]*\\p\{", out):
        return None
    return out.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")


@cache
def odd() -> str:
    """A class of the characters that Python's own classes read differently."""
    letters, numbers = _members("L"), _members("N")

    def differs(c: str) -> bool:
        own = "N" if c.isdecimal() else "L" if c.isalnum() else "S" if c.isspace() else ""
        return own != ("L" if c in letters else "N" if c in numbers else "S" if c in WHITE else "")

    return f"[{_spans(filter(differs, map(chr, range(0x110000))))}]"


def splitter(pattern: str) -> tuple[str, str | None, str]:
    """What :func:`finder` needs, made on the driver."""
    return standard(pattern), quick(pattern), odd()


def finder(made: tuple[str, str | None, str]):
    """text -> its pre-tokens."""
    exact, fast, odd_ = made
    slow = re.compile(exact).findall
    if fast is None:
        return slow
    all_, strange = re.compile(fast).findall, re.compile(odd_).search
    return lambda text: slow(text) if not text.isascii() and strange(text) or any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) else all_(text)


#: Characters of text that are split at once.
BLOCK_CHARS = 4 << 20


def blocks_of(texts: pa.Array, most: int = BLOCK_CHARS):
    """(first, last) rows of slices of about ``most`` bytes."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


class Segments:
    """A column of texts cut at its single spaces, where no pre-token crosses.

    A space between two characters that are not white space starts a pre-token in any text, so
    what stands between two such spaces is split alike wherever it occurs: ``keys`` are the
    distinct segments (with their space, but for a text's first), ``codes`` their places
    in ``keys``, ``sizes`` the segments of each text.  A text that has other white space beside a
    space is one segment as a whole.
    """

    def __init__(self, texts: pa.Array, made: tuple):
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        unusual = pc.match_substring_regex(found.dictionary, made[2]).to_numpy(zero_copy_only=False)
        order = np.argsort(unusual, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        codes, pieces = back[found.indices.to_numpy()], found.dictionary.take(pa.array(order)) if unusual.any() else found.dictionary
        offsets -= offsets[0]
        sizes, first = np.diff(offsets), offsets[:-1]
        strange = pc.match_substring_regex(pieces, _EDGE).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(strange[codes], first) if len(first) else np.zeros(0, bool)
        starts, place = np.unique(codes[first[~whole]], return_inverse=True)
        codes[first[~whole]] = len(pieces) + place
        at = np.flatnonzero(whole)
        codes[first[at]] = len(pieces) + len(starts) + np.arange(len(at))
        keep = ~np.repeat(whole, sizes)
        keep[first[at]] = True
        self.codes, self.sizes = codes[keep], np.where(whole, 1, sizes)
        # segments that begin with a space (those of strange pieces are never used), the unusual ones last
        self.inner = pc.binary_join_element_wise(_text(""), pc.if_else(pa.array(strange), _text("a"), pieces), _text(" ")).to_pylist()
        self.usual = int(len(order) - unusual.sum())
        self.outer = pieces.take(pa.array(starts)).to_pylist() + texts.take(pa.array(at)).to_pylist()
        self.keys = self.inner + self.outer
        self._made = made

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes, minlength=len(self.keys))

    def words(self) -> tuple[list[str], np.ndarray]:
        """The keys' pre-tokens, and how many each key has."""
        exact, fast, _ = self._made
        slow, quickly = re.compile(exact).findall, re.compile(fast or exact).findall
        out, sizes = [], np.ones(len(self.keys), np.int64)
        for first, last, find in ((0, self.usual, quickly), (self.usual, len(self.inner), slow)):
            found = find("".join(self.inner[first:last]))  # inside a segment no pre-token begins with a space
            begins = np.flatnonzero(np.fromiter((x[0] == " " for x in found), bool, len(found)))
            if len(begins) != last - first:
                raise ValueError("the pattern must begin a pre-token at every single space")
            sizes[first:last] = np.diff(np.append(begins, len(found)))
            out += found
        find = finder(self._made)
        for k, x in enumerate(self.outer, len(self.inner)):
            found = find(x)
            sizes[k] = len(found)
            out += found
        return out, sizes


#: Pieces that are empty or have white space at an end.
_EDGE = f"^$|^[{re.escape(WHITE)}]|[{re.escape(WHITE)}]$"



def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive runs of ``flat`` those named by ``which``, one after the other, and their sizes."""
    starts, wide = np.cumsum(sizes) - sizes, sizes[which]
    shift = starts[which] - (np.cumsum(wide) - wide)
    return flat[np.repeat(shift, wide) + np.arange(int(wide.sum()))], wide


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _counted(made: tuple):
    """mapInArrow: texts -> (word, n) with counts folded inside the task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def go(arrow):
        found: Counter = Counter()
        for b in arrow:
            for first, last in blocks_of(b.column(0)):
                got = Segments(b.column(0)[first:last], made)
                words, sizes = got.words()
                for word, n in zip(words, np.repeat(got.counts(), sizes).tolist()):
                    found[word] += n
                if len(found) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)
                    found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

    return go


def word_counts(texts: DataFrame, made: tuple) -> DataFrame:
    """One column of texts -> (word, n) over the whole corpus; ``made`` is a :func:`splitter`."""
    counts = texts.mapInArrow(_counted(made), "word string, n long")
    return counts.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = MOST_WORDS, longest: int = MOST_BYTES) -> DataFrame:
    """The most frequent words, at most ``most`` and none over ``longest`` bytes: a proven bound.

    The least count comes from a histogram of log counts, so nothing is sorted and ties are
    in or out together.
    """
    rows = _stored(counts.where(F.octet_length("word") <= longest), "word_counts")
    level = F.floor(8 * F.log2("n")).cast("int")
    by_level = {r["level"]: r["count"] for r in rows.groupBy(level.alias("level")).count().collect()}  # at most 512 rows
    least, total = None, 0
    for k in sorted(by_level, reverse=True):
        if (total := total + by_level[k]) > most:
            break
        least = k
    return rows.where(level >= least).select("word") if least is not None else rows.where("false").select("word")
