"""URL filters: all wildcard rules are simulated at once over each canonical URL by a bit-parallel automaton.

A canonical URL is ``.host/path``: the host lower-cased (A-Z only), the path as it stands, without scheme,
query and fragment. A glob is a row of literals and of three wildcards: ``?`` is one character, ``*`` any run
without a slash, ``**`` any run. Each glob owns a row of bits, one for each literal read so far and one for the
start; the rows of all globs lie side by side in 64-bit words. Reading a character moves every bit one place
where the mask of the character allows it (Shift-And) and keeps the bits that a wildcard lets loop on it. Words
carry into each other, so the number of rules is not bounded by a word.

Host rules ``host/path`` fit a host with all its subdomains and every path that starts with theirs; they become
globs ``*.host/path**``. The longest fitting host rule decides; without one the first fitting glob of the list;
without one the default. A URL takes time in proportion to its length times the words of the masks, and a batch
holds one row of words for each of its URLs, however long they are.

Nulls: a null URL, and one without ``://``, has an empty host and path, no rule and the default verdict. Repeated
rows stay rows. An empty table gives an empty result. Other columns are not read; ``judge`` returns its own only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = 4096


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{escape(self.host)}{escape(self.path)}**"


@dataclass(frozen=True)
class Glob:
    verdict: str
    pattern: str


#: The host rules of the contract.
HOST_RULES = [
    HostRule(ALLOW, "com", "/"),
    HostRule(BLOCK, "example.com", "/en/"),
    HostRule(ALLOW, "www.example.com", "/en/"),
    HostRule(BLOCK, "net", "/es/"),
    HostRule(BLOCK, "net", "/fr/"),
]

#: Globs for URLs that no host rule fits: hosts named after advertising, pills or games of chance, listings and binary files.
GLOBS = [
    Glob(BLOCK, "*.ads-*.**"),
    Glob(BLOCK, "*.ads.**"),
    Glob(BLOCK, "*pills*"),
    Glob(BLOCK, "*pills*/**"),
    Glob(BLOCK, "*casino*"),
    Glob(BLOCK, "*casino*/**"),
    Glob(BLOCK, "*/tag/**"),
    Glob(BLOCK, "*/search/**"),
    Glob(BLOCK, "**.jp?g"),
    Glob(BLOCK, "**.zip"),
]


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def tokens(glob: str) -> tuple[list[str | None], list[int]]:
    """Literals (None is any character) and, for each number of literals read, 0, 1 (loops within a segment) or 2 (loops)."""
    literals: list[str | None] = []
    loops, at = [0], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            double = glob[at : at + 2] == "**"
            loops[-1] = max(loops[-1], 1 + double)
            at += 1 + double
            continue
        if c == "\\" and at + 1 < len(glob):
            at += 1
            literals.append(glob[at])
        else:
            literals.append(None if c == "?" else c)
        loops.append(0)
        at += 1
    return literals, loops


class Automaton:
    """Shift-And masks of all globs; ``first`` gives the number of the first one that fits each text, or -1."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        bits = sum(len(loops) for _, loops in parsed)
        letters = sorted({c for literals, _ in parsed for c in literals if c is not None} | {"/"})
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        self.words = max(1, -(-bits // 64))
        kinds = len(letters) + 1  # the last one stands for all other characters
        step, loop = np.zeros((kinds, bits), dtype=bool), np.zeros((kinds, bits), dtype=bool)
        start, ends, at = np.zeros(bits, dtype=bool), [], 0
        slash = letters.index("/")
        for literals, loops in parsed:
            start[at] = True
            for k, c in enumerate(literals):
                step[slice(None) if c is None else letters.index(c), at + k + 1] = True
            for k, kind in enumerate(loops):
                loop[:, at + k] = kind > 0
                if kind == 1:
                    loop[slash, at + k] = False
            at += len(loops)
            ends.append(at - 1)
        self.step, self.loop, self.start = self._pack(step), self._pack(loop), self._pack(start[None])[0]
        self.end_word, self.end_bit = np.array(ends, dtype=np.int64) // 64, (np.array(ends, dtype=np.int64) % 64).astype(np.uint64)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(bits), self.words * 64), dtype=bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def states(self, texts: Sequence[str]) -> np.ndarray:
        """Bits of all globs after each text; texts are read side by side, character by character."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        kind = np.where(self.codes[at] == flat, at, len(self.codes)).astype(np.int32)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        active, begins, sizes = np.tile(self.start, (len(texts), 1)), begins[order], sizes[order]
        for i in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -i))  # texts longer than i
            now, which = active[:n], kind[begins[:n] + i]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            active[:n] = (moved & self.step[which]) | (now & self.loop[which])
        out = np.empty_like(active)
        out[order] = active
        return out

    def first(self, texts: Sequence[str]) -> np.ndarray:
        if not len(self.end_word):
            return np.full(len(texts), -1, dtype=np.int64)
        found = []
        for lo in range(0, len(texts), _ROWS):
            states = self.states(texts[lo : lo + _ROWS])
            hit = (states[:, self.end_word] >> self.end_bit) & np.uint64(1)
            found.append(np.where(hit.any(axis=1), hit.argmax(axis=1), -1))
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def ranked(rules: Sequence[HostRule]) -> list[HostRule]:
    """Longest rule first; fitting rules of one length have the same host and path."""
    return sorted(rules, key=lambda r: -len(r.name))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def first_match(text: Column, globs: Sequence[str]) -> Column:
    """Number of the first glob that fits the text, -1 without one."""
    automaton = Automaton(globs)

    @F.pandas_udf("int")
    def matched(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(automaton.first(texts.fillna("").tolist()), dtype="int32")

    return matched(text)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[HostRule] = HOST_RULES, globs: Sequence[Glob] = GLOBS, default: str = ALLOW) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, and the glob that gave the verdict, if one did."""
    hosts = ranked(rules)
    names = [(r.name, None, r.verdict) for r in hosts] + [(None, g.pattern, g.verdict) for g in globs]
    told = F.array(*[F.struct(F.lit(n).cast("string").alias("rule"), F.lit(g).cast("string").alias("glob"), F.lit(v).alias("verdict")) for n, g, v in names])
    address = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host_of(address), F.lit("")).alias("host"), F.coalesce(path_of(address), F.lit("")).alias("path"))
    found = rows.withColumn("match", first_match(F.concat(F.lit("."), "host", "path"), [r.glob for r in hosts] + [g.pattern for g in globs]))
    by = F.get(told, F.when(F.col("match") >= 0, F.col("match"))) if names else F.lit(None).cast("struct<rule:string,glob:string,verdict:string>")
    return found.select("page_id", "host", "path", by["rule"].alias("rule"), F.coalesce(by["verdict"], F.lit(default)).alias("verdict"), by["glob"].alias("glob"))
