"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob is a run of states in one long bit string of 64-bit words; a step over one byte is a shift, a mask for the
byte and the self-loops of `*`, so all rules advance together.  A whole Arrow batch of URLs advances at once.

The canonical form is `.host#path`: host after the first `://` up to `/`, `?`, `#` or the end with A-Z lowered, path from
there up to `?`, `#` or the end.  `#` cannot occur in either part, so a glob can tell host from path.
In a glob `*` is any run of bytes and `?` any one byte; the rest stands for itself.

Edge cases: a null url or one without `://` has empty host and path and goes through the same rules; very long URLs are
stepped in place, without padding; repeated rows get equal rows, a row without id keeps its row; of rules of equal length the
one listed last decides; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """glob over `.host#path`; name is reported; the longest named rule that fits decides, else any unnamed block rule."""
    glob: str
    verdict: str
    name: str | None = None


def host_path_rule(rule: str, verdict: str) -> Rule:
    """`example.net/en/`: that host and its subdomains, paths from there on."""
    host, _, path = rule.partition("/")
    return Rule(f"*.{host}#/{path}*", verdict, rule)


# fixed values: the rules the query names
NAMED = [host_path_rule("net/", "block"), host_path_rule("example.net/en/", "allow"), host_path_rule("example.com/de/", "block"), host_path_rule("org/fr/", "allow")]
# the filter's own list: hosts and paths not wanted in a corpus
UNWANTED = [Rule(g, "block") for g in (
    "*.adult*#*", "*.porn*#*", "*.xxx#*", "*.spam*#*", "*.casino*#*", "*.bet*.example*#*", "*.malware*#*", "*.phish*#*",
    "*#*/wp-login*", "*#*/cgi-bin/*", "*#*/login/*", "*#*/cart/*", "*#*.exe", "*#*.zip", "*#*.apk")]
RULES = NAMED + UNWANTED


class Automaton:
    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g.encode()) for g in globs]
        total = sum(len(t) + 1 for t, _ in tokens)
        self.words = -(-total // 64)
        accepts, loops, starts = np.zeros((256, total), bool), np.zeros(total, bool), np.zeros(total, bool)
        self.final, at = [], 0
        for units, loop in tokens:
            starts[at] = True
            for k, unit in enumerate(units):
                accepts[unit if unit is not None else slice(None), at + 1 + k] = True
            loops[[at + k for k in loop]] = True
            at += len(units) + 1
            self.final.append(divmod(at - 1, 64))
        self.accepts, self.loops, self.starts = self._pack(accepts), self._pack(loops[None])[0], self._pack(starts[None])[0]

    @staticmethod
    def _tokens(glob: bytes):
        """Bytes to match in order (None: any), and the states that a star lets stay."""
        units, loop = [], set()
        for c in glob:
            if c == 0x2A:
                loop.add(len(units))
            else:
                units.append(None if c == 0x3F else c)
        return units, loop

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), np.uint64)
        wide[:, : bits.shape[1]] = bits
        return (wide.reshape(len(bits), self.words, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) of booleans."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        data, start = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        start, size = start[order], size[order]
        state = np.tile(self.starts, (len(texts), 1))
        live = len(texts)
        for k in range(int(size[0]) if len(size) else 0):
            while size[live - 1] <= k:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.accepts[data[start[:live] + k]] | now & self.loops
        hit = np.stack([(state[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in self.final], axis=1).astype(bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def parts(url):
    """Columns (host, path) of a url column, both empty when it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, matched): matched counts the globs of the automaton that fit."""
    base = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    base = base.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batches):
        machine = Automaton([r.glob for r in rules])
        rank = sorted((k for k, r in enumerate(rules) if r.name), key=lambda k: len(rules[k].name))
        blocks = [k for k, r in enumerate(rules) if not r.name and r.verdict == "block"]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = machine.match([f".{h}#{p}".encode() for h, p in zip(hosts, paths)])
            best = np.full(len(hosts), -1)
            for k in rank:
                best[hit[:, k]] = k
            own = np.where(hit[:, blocks].any(axis=1), "block", "allow")
            names = [rules[k].name if k >= 0 else None for k in best]
            verdict = [rules[k].verdict if k >= 0 else str(v) for k, v in zip(best, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.string()), pa.array(verdict, pa.string()), pa.array(hit.sum(axis=1), pa.int64())],
                                             [id_col, "host", "path", "rule", "verdict", "matched"])

    new = T.StructType().add("rule", "string").add("verdict", "string").add("matched", "long")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *new.fields]))


def oracle(rules: list[Rule] = RULES) -> str:
    """DuckDB statement for judge() over pages; every glob is a LIKE over `.host#path`."""

    def fits(rule: Rule) -> str:
        if set(rule.glob) & set("%_?'!"):
            raise ValueError(f"no LIKE for {rule.glob}")
        return f"t LIKE '{rule.glob.replace('*', '%')}'"

    named = sorted((r for r in rules if r.name), key=lambda r: len(r.name))[::-1]
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in named)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in named)
    block = " OR ".join(fits(r) for r in rules if not r.name and r.verdict == "block")
    matched = " + ".join(f"({fits(r)})::BIGINT" for r in rules)
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
places AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
texts AS (SELECT *, '.' || host || '#' || path AS t FROM places)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict, {matched} AS matched FROM texts"""


def op8_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages)
