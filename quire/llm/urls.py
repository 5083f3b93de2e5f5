"""URL filter: all glob rules simulated at once by a bit-parallel automaton.

A URL is brought to a canonical form, a dot, the host and the path; so one
glob covers a host with its subdomains. Every position of every glob is one
bit of a few 64-bit words (Shift-And): a step shifts all bits, masks them with
the positions that the next byte fits, and keeps those that wait in a star.
Batches of URLs take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import text as T

U64 = np.uint64
#: Bytes of padded URLs that one step of the automaton holds at a time.
BLOCK = 1 << 22

#: (verdict, host, path): the rule fits the host and its subdomains where the path begins with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or none: empty."""
    return C.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_glob(host: str, path: str) -> str:
    """Glob over canonical URLs of a rule for a host, its subdomains, and paths that begin with path."""
    quote = lambda s: "".join("\\" + c if c in "*?\\" else c for c in s)
    return f"*.{quote(host)}{quote(path)}**"


@dataclass
class Automaton:
    """Globs over bytes: * any run without /, ** any run, ? one character but /, backslash takes the next literally."""

    first: np.ndarray  # words: the bits where patterns start
    final: np.ndarray  # for each pattern, the word and the bit of its end
    fits: np.ndarray  # 256 x words: positions that a byte may be read at
    stays: np.ndarray  # 256 x words: stars that a byte keeps waiting
    skips: np.ndarray  # words: positions that are stars, and so may be passed without reading

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        places: list[tuple[int, set[int] | None, set[int] | None]] = []
        starts, ends = [], []
        everything, within = set(range(256)), set(range(256)) - {0x2F}
        for glob in globs:
            starts.append(len(places))
            raw, i = glob.encode(), 0
            while i < len(raw):
                c = raw[i]
                if c == 0x2A:
                    double = raw[i : i + 2] == b"**"
                    places.append((0, None, everything if double else within))
                    i += 1 + double
                elif c == 0x3F:
                    places.append((0, within, None))
                    i += 1
                else:
                    i += c == 0x5C and i + 1 < len(raw)
                    places.append((0, {raw[i]}, None))
                    i += 1
            places.append((0, None, None))  # the end
            ends.append(len(places) - 1)
        words = max(1, -(-len(places) // 64))
        out = cls(np.zeros(words, U64), np.array([(e // 64, e % 64) for e in ends], np.int64).reshape(-1, 2), np.zeros((256, words), U64), np.zeros((256, words), U64), np.zeros(words, U64))
        bit = lambda p: U64(1 << (p % 64))
        for p in starts:
            out.first[p // 64] |= bit(p)
        for p, (_, reads, waits) in enumerate(places):
            for c in reads or ():
                out.fits[c, p // 64] |= bit(p)
            for c in waits or ():
                out.stays[c, p // 64] |= bit(p)
            if waits is not None:
                out.skips[p // 64] |= bit(p)
        return out

    def _pass_stars(self, state: np.ndarray) -> np.ndarray:
        """Stars may match nothing: a bit in a star also stands after it. Stars in a row are one or two long, so this is repeated until nothing changes."""
        while True:
            more = state | _shift(state & self.skips)
            if (more == state).all():
                return state
            state = more

    def run(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which patterns match each row of a padded block in full: rows x patterns."""
        state = self._pass_stars(np.repeat(self.first[None, :], len(sizes), axis=0))
        for i in range(chars.shape[1]):
            live = np.flatnonzero((sizes > i) & state.any(axis=1))
            if not len(live):
                break
            c, own = chars[live, i], state[live]
            state[live] = self._pass_stars(_shift(own & self.fits[c]) | (own & self.stays[c]))
        return (state[:, self.final[:, 0]] >> self.final[:, 1].astype(U64)) & U64(1) != 0


def _shift(state: np.ndarray) -> np.ndarray:
    """All bits one up, across words."""
    out = state << U64(1)
    out[:, 1:] |= state[:, :-1] >> U64(63)
    return out


def blocks(data: np.ndarray, offsets: np.ndarray):
    """Rows of about equal length, padded: (row numbers, chars, sizes). Padding at most doubles a block."""
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        least = max(int(sizes[order[begin]]), 8)
        end = begin + int(np.searchsorted(sizes[order[begin:]], 2 * least, side="right"))
        end = min(end, begin + max(1, BLOCK // (2 * least)))
        rows = order[begin:end]
        width = int(sizes[rows].max(initial=0))
        at = offsets[rows][:, None] + np.arange(width)
        yield rows, data[np.minimum(at, max(len(data) - 1, 0))] if width else np.zeros((len(rows), 0), np.uint8), sizes[rows]
        begin = end


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs: tuple[tuple[str, str], ...] = (), default: str = DEFAULT) -> DataFrame:
    """Verdict on every row: page_id, host, path, rule, verdict, globs_hit.

    rules are (verdict, host, path); globs are (verdict, glob over the canonical
    URL) of one's own. Of the rules that fit, the longest wins, of equally long
    ones the first; without a rule, the first glob that fits; else the default.
    A null URL or one without :// has an empty host and path. Rows, repeated
    ones too, are judged one by one and nothing is shuffled.
    """
    texts = [host + path for _, host, path in rules]
    verdicts = [r[0] for r in rules] + [g[0] for g in globs]
    patterns = [rule_glob(host, path) for _, host, path in rules] + [g for _, g in globs]
    longest = sorted(range(len(rules)), key=lambda i: (-len(texts[i]), i)) + list(range(len(rules), len(patterns)))
    automaton = Automaton.of(patterns)

    def match(batches):
        for batch in batches:
            data, offsets = T.buffer_of(batch.column(3))
            best = np.full(batch.num_rows, -1)
            for rows, chars, sizes in blocks(data, offsets) if patterns else ():
                hit = automaton.run(chars, sizes)[:, longest]
                best[rows] = np.where(hit.any(axis=1), np.array(longest)[hit.argmax(axis=1)], -1)
            rule = [texts[i] if 0 <= i < len(texts) else None for i in best.tolist()]
            verdict = [verdicts[i] if i >= 0 else default for i in best.tolist()]
            hit = [patterns[i] if i >= len(texts) else None for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(hit, pa.string())], ["page_id", "host", "path", "rule", "verdict", "globs_hit"])

    C.ship(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    return base.mapInArrow(match, "page_id long, host string, path string, rule string, verdict string, globs_hit string")
