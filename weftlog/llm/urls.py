"""URL filters: rules first, then gradient-boosted trees on lexical features, fitted to the URLs that rules decide.

Host, path and rule are column expressions. Features are counted in numpy over a batch's bytes. Suffix statistics cover all
distinct labelled URLs: a table of bounded size has for each hash of a suffix, and for each fifth of the URLs (FOLDS, by hash),
how many are labelled and how many are blocked. A labelled URL's own fifth is left out of its statistics, so that trees are not
fitted to labels that their features have seen, nor judged by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import by_row

# The rules, as host and path, and what they say.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: The classifier is fitted on so many distinct labelled URLs at most (those with the smallest hashes); one of the FOLDS is held out.
SAMPLE, FOLDS = 20_000, 5
#: Places of the table of statistics, for last labels and for last two labels of hosts.
PLACES = {"suffix": 1 << 12, "domain": 1 << 16}
ROUNDS, DEPTH, BINS, RATE = 40, 4, 32, 0.2
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "marks", "suffix_rate", "suffix_share", "domain_rate", "domain_share")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """Between the first `?` behind the host and the `#`; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the URL's or a domain above it, and whose path starts the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, slash, start = rule.partition("/")
        out = F.when(((host == at) | host.endswith(f".{at}")) & path.startswith(slash + start), F.lit(rule)).otherwise(out)
    return out


def placed(url: Column, rules: dict[str, str]) -> dict[str, Column]:
    """host, path, query, rule, and the places of the host's last label and last two labels in the table of statistics."""
    host, path = host_of(url), path_of(url)
    at = {"suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2)}
    return {"host": host, "path": path, "query": query_of(url), "rule": rule_of(host, path, rules)} | {k: F.pmod(F.xxhash64(v), F.lit(PLACES[k])).cast("int") for k, v in at.items()}


DIGIT, MARK, SLASH, AND, DOT = (common.byte_class(x) for x in (b"0123456789", b"-_%~", b"/", b"&", b"."))


def counted(member: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return by_row(member[data], offs)


def entropy(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits a byte of each row, by the row's own shares of bytes."""
    sizes, out = np.diff(offs), np.zeros(len(offs) - 1)
    for i in range(0, len(sizes), 1024):
        own, cut = sizes[i : i + 1024], data[offs[i] : offs[min(i + 1024, len(sizes))]]
        counts = np.bincount(np.repeat(np.arange(len(own)), own) * 256 + cut, minlength=256 * len(own)).reshape(-1, 256)
        share = counts / np.maximum(own, 1)[:, None]
        out[i : i + 1024] = -(share * np.log2(np.where(counts > 0, share, 1))).sum(1)
    return out


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array) -> np.ndarray:
    """The features that need no statistics, a row for each URL. Lengths are in bytes."""
    (u, uo), (h, ho), (p, po), (q, qo) = (common.text_bytes(c) for c in (url, host, path, query))
    size = np.diff(uo)
    return np.stack([size, np.diff(ho), counted(SLASH, p, po), counted(DIGIT, u, uo) / np.maximum(size, 1), entropy(u, uo), counted(AND, q, qo) + (np.diff(qo) > 0), counted(DOT, h, ho) + 1, counted(MARK, u, uo)], 1).astype(float)


@dataclass
class Model:
    """Boosted trees (each a list of feature, threshold, left value or child ...) over lexical features and suffix statistics.

    stats: for suffix and domain an array of places by folds, with the numbers of labelled and of blocked URLs.
    """

    stats: dict[str, np.ndarray] = field(default_factory=lambda: {k: np.zeros((n, FOLDS, 2)) for k, n in PLACES.items()})
    prior: float = -1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    accuracy: float | None = None
    majority: float | None = None

    def rates(self, kind: str, place: np.ndarray, fold: np.ndarray | None) -> list[np.ndarray]:
        """The smoothed share of blocked URLs at a place, and its share of all; without the URL's own fold, if that is given."""
        x, every = self.stats[kind][place].sum(1), self.stats[kind].sum((0, 1))[0]
        if fold is not None:
            x, every = x - self.stats[kind][place, fold], every - self.stats[kind].sum(0)[fold, 0]
        return [(x[:, 1] + 1) / (x[:, 0] + 2), x[:, 0] / np.maximum(every, 1)]

    def features(self, t: pa.RecordBatch | pa.Table, fold: np.ndarray | None = None) -> np.ndarray:
        """t: url, host, path, query, suffix, domain."""
        whole = {k: c.combine_chunks() if isinstance(c := t.column(k), pa.ChunkedArray) else c for k in ("url", "host", "path", "query", *PLACES)}
        texts, places = [whole[k] for k in ("url", "host", "path", "query")], {k: whole[k].to_numpy(zero_copy_only=False) for k in PLACES}
        return np.concatenate([lexical(*texts), *(r[:, None] for k in PLACES for r in self.rates(k, places[k], fold))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """One tree of full depth by the best gain in each node's histograms, and what it adds to each row."""
    inner, n_features = 2**DEPTH - 1, binned.shape[1]
    which, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(grad), np.int64)
    for level in range(DEPTH):
        base, width = 2**level - 1, 2**level
        local, best = node - base, np.full(width, 1e-6)
        for f in range(n_features):
            key = local * BINS + binned[:, f]
            g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(1)
            h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(1)
            gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[:, len(cuts[f]) :] = 0
            k = gain.argmax(1)
            better = gain[np.arange(width), k] > best
            best[better] = gain[np.arange(width), k][better]
            which[base : base + width][better] = f
            cut[base : base + width][better] = cuts[f][np.minimum(k, max(0, len(cuts[f]) - 1))][better] if len(cuts[f]) else np.inf
        place = np.array([np.searchsorted(cuts[f], c) if np.isfinite(c) else BINS for f, c in zip(which[base : base + width], cut[base : base + width], strict=True)])
        node = 2 * node + 1 + (binned[np.arange(len(grad)), which[node]] > place[local])
    leaf = node - inner
    value = -RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
    return (which, cut, value), value[leaf]


def between(column: np.ndarray) -> np.ndarray:
    """Where a feature is cut: halfway between neighbouring values, at BINS - 1 even shares of the rows at most."""
    values = np.unique(column)
    at = np.searchsorted(values, np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]), "right") - 1
    at = np.unique(at[at < len(values) - 1])
    return (values[at] + values[at + 1]) / 2


def fit(x: np.ndarray, blocked: np.ndarray, fold: np.ndarray, stats: dict[str, np.ndarray] | None = None) -> Model:
    """Trees for the features of sampled URLs; the last fold is held out and gives the accuracy, and the share of its larger class.

    Without labels of both kinds the model is their one kind (none: allow).
    """
    model = Model() if stats is None else Model(stats)
    if not len(x) or blocked.all() or not blocked.any():
        model.prior = 1.0 if len(x) and blocked.all() else -1.0
        return model
    held = fold == FOLDS - 1
    if held.all() or not held.any():  # too few to hold some out
        held = np.zeros(len(x), bool)
    y, known = blocked[~held].astype(float), x[~held]
    cuts = [between(c) for c in known.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, known.T, strict=True)], 1)
    mean = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model.prior = math.log(mean / (1 - mean))
    score = np.full(len(y), model.prior)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree, step = grow(binned, cuts, p - y, p * (1 - p))
        model.trees.append(tree)
        score += step
    if held.any():
        model.accuracy = float(((model.score(x[held]) > 0) == blocked[held]).mean())
        model.majority = float(max(blocked[held].mean(), 1 - blocked[held].mean()))
    return model


def train(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, url_col: str = "url") -> Model:
    """Counts the statistics of all distinct URLs that rules decide, whose verdicts are the labels, and fits the trees to at most `sample` of them."""
    common.tune(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    seen = pages.select(url.alias("url")).filter(rule_of(host_of(url), path_of(url), rules).isNotNull()).distinct()
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    rows = seen.select("url", *(c.alias(k) for k, c in placed(F.col("url"), rules).items()), F.xxhash64("url").alias("h"))
    rows = common.save(rows.select("url", "host", "path", "query", "suffix", "domain", blocked.alias("blocked"), "h", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold")))
    stats = {}
    for kind, size in PLACES.items():
        stats[kind] = np.zeros((size, FOLDS, 2))
        found = rows.groupBy(kind, "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad")).toPandas()  # a row for each place and fold at most
        stats[kind][found[kind], found["fold"]] = found[["n", "bad"]].to_numpy(float)
    # the sample: hashes are even and URLs distinct, so few over the sample's size lie below this bound, spread over all tasks
    share = min(1.0, 2 * sample / max(1.0, stats["suffix"][:, :, 0].sum()))
    few = rows.filter(F.col("h") <= int(share * 2**64) - 2**63 - 1) if share < 1 else rows
    found = few.orderBy("h", "url").limit(sample).toArrow()
    common.discard(rows)
    fold = found.column("fold").to_numpy()
    return fit(Model(stats).features(found, fold), found.column("blocked").to_numpy().astype(bool), fold, stats)


JUDGED = "page_id long, host string, path string, rule string, verdict string, score double"


def _judge(rules: dict[str, str], model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            score = model.score(model.features(batch))
            verdicts = [rules[r] if r else ("block" if s > 0 else "allow") for r, s in zip(batch.column("rule").to_pylist(), score.tolist(), strict=True)]
            yield common.table(**{k: batch.column(k) for k in ("page_id", "host", "path", "rule")}, verdict=pa.array(verdicts, pa.string()), score=1 / (1 + np.exp(-score)))

    return run


def judge(pages: DataFrame, model: Model | None = None, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: host, path, the rule that fits (else null), the verdict, and the trees' probability of a block.

    A null URL, or one without `://`, has an empty host and path, fits no rule and is judged by the trees. Null ids and
    repeated rows stay (a repeated URL counts once in training); an empty table gives no rows; other columns play no part.
    """
    common.tune(pages.sparkSession)
    model = model or train(pages, rules, url_col=url_col)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("page_id", "url", *(c.alias(k) for k, c in placed(F.col("url"), rules).items()))
    return rows.mapInArrow(_judge(rules, model), JUDGED)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
