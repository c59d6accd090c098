"""URL filters: many glob rules in one bit-parallel wildcard automaton.

Every glob is compiled to the bits of a multiword Shift-And mask: one bit for
each literal byte, with a self loop on the bit before a ``*``.  All patterns of
all URLs of a batch advance together, one byte position at a time, as rows of a
``uint64`` matrix.  A URL is canonicalised to ``.host`` + 0x1F + ``path``; the
mark 0x1F cannot occur in a canonical host or path, so a host wildcard never
runs into the path.
"""

from typing import Iterable, Iterator, NamedTuple, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import text_buffer

MARK = "\x1f"


class Rule(NamedTuple):
    """A rule fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{MARK}{self.path}*"


# The rules asked for.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

# Parts of host names that mark junk, endings of hosts, and paths that are no content.
JUNK_HOSTS = (
    "casino", "cheap-pills", "spam-farm", "online-poker", "sportsbet", "slot-machine", "payday-loan", "forex-signal", "binary-options", "viagra", "cialis", "weight-loss-pill", "replica-watch", "free-followers",
    "link-exchange", "article-spinner", "keygen", "warez", "torrent-download", "free-movies-hd", "doubleclick", "ad-server", "adtracker", "clicktrack", "popunder", "pixel-tracker", "survey-prize", "crypto-doubler",
)
JUNK_ENDINGS = (".xxx", ".adult", ".porn", ".sexy", ".bet", ".loan")
NO_CONTENT = ("/wp-login.php", "/wp-admin/", "/xmlrpc.php", "/phpmyadmin/", "/cgi-bin/", "/cart/checkout", "/user/login", "/account/signin", "/.git/", "/.env", "/calendar/ical/", "/print-preview/", "/tag-cloud/")

# Globs over the canonical form; a URL no rule fits is blocked where one of them matches.  A path that ends with a slash may go on.
BLOCK_GLOBS = (
    *(f"*{part}*{MARK}*" for part in JUNK_HOSTS),
    *(f"*{ending}{MARK}*" for ending in JUNK_ENDINGS),
    *(f"*{MARK}*{path}{'*' if path.endswith('/') else ''}" for path in NO_CONTENT),
)


class GlobAutomaton:
    """Shift-And over several 64-bit words; only ``*`` is special in a glob."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        literal, loops, first, self._final = [], [], [], []
        for glob in self.globs:
            parts = glob.encode("utf-8").split(b"*")
            first.append(len(literal))
            # Bit 0 of a pattern stands for "nothing read yet"; each byte adds a bit.
            literal.append(None)
            loops.append(False)
            for k, part in enumerate(parts):
                if k:
                    loops[-1] = True
                for byte in part:
                    literal.append(byte)
                    loops.append(False)
            self._final.append(len(literal) - 1)
        self.bits = len(literal)
        self.words = max(1, -(-self.bits // 64))
        self._step = np.zeros((256, self.words), np.uint64)
        self._loop = np.zeros(self.words, np.uint64)
        self._start = np.zeros(self.words, np.uint64)
        for i, (byte, loop) in enumerate(zip(literal, loops)):
            bit = np.uint64(1) << np.uint64(i % 64)
            if byte is not None:
                self._step[byte, i // 64] |= bit
            if loop:
                self._loop[i // 64] |= bit
        for i in first:
            self._start[i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def matches(self, texts: pa.Array, chunk: int = 4096) -> np.ndarray:
        """A boolean matrix, texts by globs: the glob matches the whole text.  Nulls are empty texts."""
        data, offsets = text_buffer(texts)
        length = np.diff(offsets)
        out = np.zeros((len(length), len(self.globs)), bool)
        order = np.argsort(-length, kind="stable")  # like lengths together: the running ones are a prefix
        for low in range(0, len(order), chunk):
            rows = order[low : low + chunk]
            base, size = offsets[rows], length[rows]
            state = np.repeat(self._start[None, :], len(rows), axis=0)
            live = len(rows)
            for at in range(int(size[0]) if len(rows) else 0):
                live = int(np.searchsorted(-size, -at, side="left"))
                now = state[:live]
                shifted = now << np.uint64(1)
                shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:live] = (shifted & self._step[data[base[:live] + at]]) | (now & self._loop)
            for g, bit in enumerate(self._final):
                out[rows, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise("")
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    head = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    path = F.when((F.instr(url, "://") > 0) & (F.instr(head, "/") > 0), F.substring(head, F.instr(head, "/"), F.length(head))).otherwise("")
    return F.coalesce(path, F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))


def filter_urls(
    df: DataFrame,
    url: str = "url",
    rules: Iterable[Rule] = RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """Adds host, path, rule and verdict to df (columns of these names are replaced).

    The longest fitting rule gives the verdict; where none fits, rule is null
    and the verdict is ``block`` if one of block_globs matches, else ``allow``.
    A null URL, or one without ``://``, has an empty host and path and is
    allowed.  Rows are kept as they are, repeated ones too; an empty table
    gives an empty one.
    """
    rules, block_globs = list(rules), list(block_globs)
    ranked = sorted(range(len(rules)), key=lambda k: len(rules[k].name))
    automaton = GlobAutomaton([r.glob for r in rules] + block_globs)

    @F.pandas_udf("rule string, verdict string")
    def judged(canonical: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in canonical:
            found = automaton.matches(pa.array(part, type=pa.string()))
            best = np.full(len(part), -1)
            for k in ranked:
                best[found[:, k]] = k
            bad = found[:, len(rules) :].any(axis=1)
            rule = [rules[k].name if k >= 0 else None for k in best]
            verdict = [rules[k].verdict if k >= 0 else ("block" if b else "allow") for k, b in zip(best, bad)]
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    names = ("host", "path", "rule", "verdict")
    kept = [c for c in df.columns if c.lower() not in names]
    clean = lambda c: F.translate(c, MARK, "\ufffd")
    parts = df.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    canonical = F.concat(F.lit("."), clean(F.col("host")), F.lit(MARK), clean(F.col("path")))
    return parts.withColumn("_judged", judged(canonical)).select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_judged.rule").alias("rule"), F.col("_judged.verdict").alias("verdict"))


def oracle_sql(table: str = "pages", key: str = "page_id", rules: Iterable[Rule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> str:
    """The same verdicts as DuckDB SQL."""
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    globs = " OR ".join("regexp_full_match(canonical, '{}', 's')".format("".join(".*" if c == "*" else c if c.isalnum() or c == MARK else "\\" + c for c in g)) for g in block_globs)
    rest = "substr(url, instr(url, '://') + 3)"
    return f"""
WITH rules(verdict, host, path) AS (VALUES {listed}),
urls AS (
  SELECT {key}, CASE WHEN contains(url, '://') THEN translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM {table}),
ready AS (SELECT {key}, coalesce(host, '') AS host, coalesce(path, '') AS path FROM urls),
fit AS (
  SELECT u.{key}, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM ready u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.{key})
SELECT {key}, host, path, rule,
  coalesce(verdict, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT r.*, f.rule, f.verdict, '.' || r.host || '{MARK}' || r.path AS canonical FROM ready r LEFT JOIN fit f USING ({key}))"""
