"""URL filters: rules by host and path, and a ratio of two character models for urls that no rule fits.

The models are variable-order Markov models of the urls that rules allow and of those that they block. Characters fall into 32
symbols, so that the counts of four in a row are 2**20 numbers a class whatever the input: an exact table of that bound, which is
sent to every task, and scoring shuffles nothing. Shorter histories are sums over it. Each order goes on to the next shorter one by
the number of different symbols that follow a history (Witten and Bell), down to the uniform distribution.

The score of a url is its mean over symbols of log P(allowed) - log P(blocked). It is calibrated on labelled urls that the models
have not learnt from: the threshold is where the two classes are told apart best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import free_name, materialize

# The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Rules are part of the plan; so many are allowed.
MOST_RULES = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The symbols: 0 is any other character and the start, then letters, "0" for any digit, and marks.
SYMBOLS = "~" + LOWER + "0.-/_"
ORDER = 3
SIZE = len(SYMBOLS)

#: Steps of a threshold, a unit of score.
STEPS = 100


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, ASCII letters in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules that fit, or null: its host is the url's or a domain above it, its path begins the url's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit a plan")
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def symbols(text: bytes) -> np.ndarray:
    """The symbols of UTF-8 bytes: one for each character."""
    return _CODES[np.frombuffer(text, np.uint8)][_STARTS[np.frombuffer(text, np.uint8)]]


_CODES = np.zeros(256, np.int64)
for _code, _char in enumerate(SYMBOLS[1:], 1):
    _CODES[ord(_char)] = _code
for _char in UPPER:
    _CODES[ord(_char)] = SYMBOLS.index(_char.lower())
for _char in "123456789":
    _CODES[ord(_char)] = SYMBOLS.index("0")
#: Bytes that begin a character.
_STARTS = (np.arange(256) & 0xC0) != 0x80


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all texts one after the other, the numbers of each symbol with the ORDER symbols before it; and the lengths of texts."""
    parts = [symbols(t.encode()) for t in texts.to_pylist()]
    lengths = np.array([len(p) for p in parts], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), lengths
    start = np.zeros(ORDER, np.int64)
    whole = np.concatenate([x for p in parts for x in (start, p)])
    codes = sum(whole[i : len(whole) - ORDER + i] * SIZE ** (ORDER - i) for i in range(ORDER + 1))
    # A code begins at each place; those that would end in the padding of a text are left out.
    ends = np.repeat(np.arange(len(parts)) * ORDER, lengths) + np.arange(lengths.sum())
    return codes[ends], lengths


def counted(df: DataFrame) -> np.ndarray:
    """Of rows (text, allowed), how often each gram comes in blocked and in allowed texts: 2 x SIZE ** (ORDER + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = grams(b.column("text"))
            both = codes + np.repeat(b.column("allowed").to_numpy(zero_copy_only=False).astype(np.int64), lengths) * SIZE ** (ORDER + 1)
            met, n = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(met, pa.int64()), "n": pa.array(n, pa.int64())})

    found = df.select("text", "allowed").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * SIZE ** (ORDER + 1), np.int64)
    table[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(2, -1)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(last symbol | those before it) of every gram, from the counts of one class."""
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        # Counts of the last `order` symbols before, and the symbol: sums over what lies further back.
        n = counts.reshape(-1, SIZE**order, SIZE).sum(0).astype(np.float64)
        kinds = (n > 0).sum(1, keepdims=True)
        total = n.sum(1, keepdims=True)
        # The distribution of the history without its first symbol.
        shorter = np.tile(p.reshape(-1, SIZE), (SIZE if order else 1, 1))
        p = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(p).ravel()


def scored(df: DataFrame, text: str, ratios: np.ndarray, name: str) -> DataFrame:
    """df with the mean ratio over the symbols of a text in a column `name`, 0 where there is none."""
    kept = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = grams(b.column(text))
            of = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.bincount(of, ratios[codes], len(lengths)) if len(codes) else np.zeros(len(lengths))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(sums / np.maximum(lengths, 1), 9), pa.float64())], names=[*b.schema.names, name])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{columns}, `{name}` double")


def held_out(text: Column) -> Column:
    """Three sixteenths of all texts, equal ones together."""
    return F.substring(F.md5(text.cast("binary")), 1, 1).isin("0", "1", "2")


def threshold(labelled: DataFrame) -> float:
    """Of scored rows (score, allowed), the value in steps below which most of the blocked ones and least of the allowed ones lie: the
    greatest difference of shares; of equals the value nearest to 0, and then the smaller one; 0 if either class has no rows."""
    n: dict[int, list[int]] = {}
    for r in labelled.groupBy(F.floor(F.col("score") * STEPS).alias("bin"), "allowed").agg(F.count("*").alias("n")).collect():
        n.setdefault(r.bin, [0, 0])[r.allowed] += r.n
    blocked, allowed = (sum(x[c] for x in n.values()) for c in (0, 1))
    if not blocked or not allowed:
        return 0.0
    bins, below, found = sorted(n), [0, 0], []
    for k, low in enumerate(bins):
        below = [below[0] + n[low][0], below[1] + n[low][1]]
        # Any value from the end of this bin to the start of the next one parts the rows alike.
        high = bins[k + 1] if k + 1 < len(bins) else low + 1
        edge = max(low + 1, min(0, high))
        found.append((-(below[0] / blocked - below[1] / allowed), abs(edge), edge))
    return min(found)[2] / STEPS


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, keep: list[str] | None = None) -> DataFrame:
    """host, path, rule, verdict and score of every row, after the columns `keep` (none if None).

    rules: (allow or block, "host/path"). A rule's verdict holds; urls without one are blocked if their score is below the
    threshold. All urls that rules fit are learnt from or calibrate. Defined results: a null url, or one without "://", has an empty
    host and path, no rule, score 0 and is judged like any other; if rules allow none or block none, the rest is allowed. Repeated
    rows are judged each; an empty table gives an empty one. A column of `keep` that has the name of a result is an error."""
    keep = keep or []
    if clash := {c.lower() for c in keep} & {"host", "path", "rule", "verdict", "score"}:
        raise ValueError(f"columns {sorted(clash)} have names of results; rename them")
    link = F.col(f"`{url}`")
    parsed = pages.select(*(f"`{c}`" for c in keep), host_of(link).alias("host"), path_of(link).alias("path"))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r for how, r in rules if how == "allow"])
    text = F.concat("host", "path")
    model = train(ruled.where("rule IS NOT NULL").select(text.alias("text"), allowed.alias("allowed")))
    name = free_name(ruled.columns, "text")
    found = ruled.withColumn(name, text)
    if model is None:
        found, said = found.withColumn("score", F.lit(0.0)), F.lit("allow")
    else:
        ratios, least = model
        found, said = scored(found, name, ratios, "score"), F.when(F.col("score") < least, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), said).when(allowed, "allow").otherwise("block")
    return found.select(*(f"`{c}`" for c in keep), "host", "path", "rule", verdict.alias("verdict"), "score")


def train(labelled: DataFrame) -> tuple[np.ndarray, float] | None:
    """The log ratios of all grams and the threshold, from rows (text, allowed); None if a class has no texts to learn from."""
    out = labelled.withColumn("out", held_out(F.col("text")))
    counts = counted(out.where("NOT out"))
    if not counts.sum(1).all():
        return None
    ratios = log_probabilities(counts[1]) - log_probabilities(counts[0])
    return ratios, threshold(scored(out.where("out").select("text", "allowed"), "text", ratios, "score"))


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """The same over the table pages."""
    cases = " ".join(
        f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN '{d}/{p}'"
        for d, p in (r.split("/", 1) for _, r in sorted(rules, key=lambda r: (-len(r[1]), r[1])))
    )
    allow = ", ".join(f"'{r}'" for how, r in rules if how == "allow")
    orders = []
    for k in range(ORDER + 1):
        # h: the k symbols before, s: the symbol; every history and symbol that is asked for, in either class.
        shorter = f"JOIN p{k - 1} b ON b.allowed = a.allowed AND b.s = a.s AND b.h = substr(a.h, 2)" if k else ""
        base = "b.p" if k else f"1.0::DOUBLE / {SIZE}"
        orders.append(f"""
n{k} AS (SELECT allowed, right(g[1:{ORDER}], {k}) AS h, g[{ORDER + 1}] AS s, count(*) AS n FROM grams WHERE learnt GROUP BY ALL),
t{k} AS (SELECT allowed, h, sum(n) AS total, count(*) AS kinds FROM n{k} GROUP BY ALL),
a{k} AS (SELECT DISTINCT c.allowed, right(g[1:{ORDER}], {k}) AS h, g[{ORDER + 1}] AS s FROM grams, (VALUES (true), (false)) c(allowed)),
p{k} AS MATERIALIZED (SELECT a.allowed, a.h, a.s, CASE WHEN t.total IS NULL THEN {base} ELSE (coalesce(n.n, 0) + t.kinds * {base}) / (t.total + t.kinds) END AS p
  FROM a{k} a {shorter} LEFT JOIN t{k} t ON t.allowed = a.allowed AND t.h = a.h LEFT JOIN n{k} n ON n.allowed = a.allowed AND n.h = a.h AND n.s = a.s)""")
    return f"""WITH u AS (SELECT *, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS MATERIALIZED (SELECT *, CASE {cases} END AS rule,
  '{"~" * ORDER}' || translate(regexp_replace(host || path, '[^A-Za-z0-9./_-]', '~', 'g'), '{UPPER}123456789', '{LOWER}000000000') AS z,
  substr(md5(host || path), 1, 1) IN ('0', '1', '2') AS out FROM v),
grams AS MATERIALIZED (SELECT r, rule IN ({allow}) AS allowed, rule IS NOT NULL AND NOT out AS learnt, substr(z, CAST(i AS INTEGER), {ORDER + 1}) AS g
  FROM (SELECT r, rule, out, z, unnest(range(1, length(z) - {ORDER} + 1)) AS i FROM w)),
{",".join(orders)},
q AS (SELECT r, round(avg(ln(x.p) - ln(y.p)), 9) AS score FROM grams
  JOIN p{ORDER} x ON x.allowed AND x.h = g[1:{ORDER}] AND x.s = g[{ORDER + 1}] JOIN p{ORDER} y ON NOT y.allowed AND y.h = x.h AND y.s = x.s GROUP BY r),
k AS (SELECT w.*, rule IN ({allow}) AS allowed, coalesce(score, 0) AS score FROM w LEFT JOIN q USING (r)),
b AS (SELECT floor(score * {STEPS}) AS bin, count(*) FILTER (WHERE allowed) AS na, count(*) FILTER (WHERE NOT allowed) AS nb FROM k WHERE rule IS NOT NULL AND out GROUP BY ALL),
e AS (SELECT greatest(bin + 1, least(0, coalesce(lead(bin) OVER o, bin + 1))) AS edge, sum(nb) OVER o / sum(nb) OVER () - sum(na) OVER o / sum(na) OVER () AS gain FROM b WINDOW o AS (ORDER BY bin)),
m AS (SELECT coalesce((SELECT edge FROM e WHERE gain IS NOT NULL AND isfinite(gain) ORDER BY gain DESC, abs(edge), edge LIMIT 1), 0) / {STEPS} AS least,
  (SELECT count(DISTINCT allowed) FROM grams WHERE learnt) = 2 AS ready)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN ready AND score < least THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN ready THEN score ELSE 0 END AS score FROM k, m"""
