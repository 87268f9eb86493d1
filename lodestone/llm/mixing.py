"""Mixing a corpus to target weights with soft domain membership, in DataFrame operations only.

1. A classifier learned from the labelled table: words of a bounded sample of labelled documents fall into BUCKETS by
   hash; buckets of like domain profile (leading domain, and how clearly it leads) form groups; a multinomial naive Bayes
   over the groups gives every document's posterior over the domains. A text is mapped to one symbol a word and the symbols are
   counted, so scoring is one projection. Evidence beyond that of EVIDENCE words is scaled back to theirs.
2. Documents of nearly equal posterior (to one part in GRID) share a cell. Expected domain tokens are summed by
   cell, from the documents' own posteriors; the number of cells depends on the domains, not on the input.
3. Projected gradient with momentum minimises the squared distance between the expected domain totals and the targets over
   nonnegative rates: rate <- max(0, rate - posterior . residual / L). L, the largest expected domain total, bounds the curvature
   in the metric weighted by tokens, so the steps converge for any target.
4. Each document takes its cell's rate, and becomes floor(rate) copies, and one more with the probability of the rest,
   decided by a hash of its id.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples, workspace

PER_DOMAIN = 2000
BUCKETS = 8192
#: How far, in nats, the leading domain of a bucket lies above its share of all words: bounds of the levels.
LEVELS = (0.15, 0.6, 1.2)
EVIDENCE = 100
GRID = 10
BLOCK = 25
MAX_DOMAINS = 64
SMOOTHING = 1.0
SPACE = "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Runs of non-white-space in lower case. Plain replacements and a split at one character are several times cheaper than a pattern."""
    text = F.lower(text)
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class _Classifier:
    """Groups of word buckets and the log-probabilities of the groups, as literals of one projection."""

    def __init__(self, domains: list[str], prior: list[float], counts: dict[tuple[int, int], int]):
        self.domains = domains
        k = len(domains)
        total = [sum(n for (_, d), n in counts.items() if d == j) + SMOOTHING for j in range(k)]
        rates: list[list[float]] = [[SMOOTHING / BUCKETS / total[j] for j in range(k)] for _ in range(BUCKETS)]
        for (b, j), n in counts.items():
            rates[b][j] += n / total[j]
        groups: dict[tuple[int, int], int] = {}
        mass: list[list[float]] = []
        self.group_of = []
        for row in rates:
            seen = sum(row)
            lead = max(range(k), key=lambda j: (row[j], -j))
            level = sum(math.log(k * row[lead] / seen) > bound for bound in LEVELS)
            g = groups.setdefault((lead, level) if level else (0, 0), len(groups))
            if g == len(mass):
                mass.append([0.0] * k)
            mass[g] = [a + b for a, b in zip(mass[g], row, strict=True)]
            self.group_of.append(g)
        whole = [sum(m[j] for m in mass) for j in range(k)]
        self.log = [[math.log((m[j] + 1e-9) / (whole[j] + 1e-9)) for m in mass] for j in range(k)]
        self.prior = [math.log(max(p, 1e-12)) for p in prior]

    def posterior(self, words: Column) -> Column:
        symbol = lambda g: chr(0x100 + g)
        table = F.split(F.lit("".join(symbol(g) for g in self.group_of)), "")
        text = F.array_join(F.transform(words, lambda w: F.get(table, _bucket(w))), "")
        held = _let(text, lambda t: F.array(*(F.length(t) - F.length(F.replace(t, F.lit(symbol(g)), F.lit(""))) for g in range(len(self.log[0])))))
        scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size(words), F.lit(1)))
        weights = F.from_json(F.lit(json.dumps([[p, *row] for p, row in zip(self.prior, self.log, strict=True)])), "array<array<double>>")
        add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

        def softmax(logits: Column) -> Column:
            up = _let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
            return _let(up, lambda e: _let(add(e), lambda total: F.transform(e, lambda x: x / total)))

        score = lambda n: F.transform(weights, lambda row: F.get(row, F.lit(0)) + scale * add(F.zip_with(F.slice(row, 2, len(self.log[0])), n, lambda w, c: w * c)))
        return _let(held, lambda n: _let(score(n), softmax))


def _let(value: Column, body) -> Column:
    """Bind a value once, so that lambdas inside do not work it out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", total_tokens: int | None = None, per_domain: int = PER_DOMAIN, max_steps: int = 300, tolerance: float = 1e-6, seed: int = 1
) -> DataFrame:
    """(id, cell, n_tokens, rate, copies) for every input row.

    `labelled` has the ids of the rows whose domain, any column of `docs`, is to be learned from, at most `per_domain` of
    each domain; rows whose domain or id is null do not count. `targets` are weights by domain (missing domains get 0; all domains
    found get equal weights by default), scaled to sum to 1; `total_tokens` is what the mix should hold (the input's
    tokens by default). Null and empty texts have no tokens and the posterior of the domains' shares. Rows that repeat
    an id get equal copies for equal texts; rows with a null id decide by a fixed hash. Without labelled rows or tokens
    all rates are 1. Targets out of reach (no document resembles the domain) are met as nearly as least squares over
    nonnegative rates of the cells can. More than MAX_DOMAINS domains are an error. An empty table gives an empty
    table; other columns of `docs` are not read.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    placed, rates = _fit(docs, parts, labelled, targets, id_col, text_col, domain_col, total_tokens, per_domain, max_steps, tolerance)
    joined = placed.join(F.broadcast(rates), "cell", "left")
    return joined.select(F.col("id").alias(id_col), "cell", "n_tokens", "rate", _copies(F.col("id"), seed).alias("copies"))


def apply_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", total_tokens: int | None = None, per_domain: int = PER_DOMAIN, max_steps: int = 300, tolerance: float = 1e-6, seed: int = 1) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as mixing_rates() says; no row of text is shuffled. Same cases as there."""
    parts = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    placed, rates = _fit(docs, parts, labelled, targets, id_col, text_col, domain_col, total_tokens, per_domain, max_steps, tolerance)
    counted = placed.join(F.broadcast(rates), "cell", "left").select("row", _copies(F.col("id"), seed).alias("copies")).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _learn(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, per_domain: int) -> _Classifier | None:
    """Counts of (bucket, domain) over the sample; the driver sees BUCKETS x domains counts at most."""
    known = docs.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("label")).where("label is not null and id is not null")
    known = workspace.materialise(known.join(labelled.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"), "labelled")
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MAX_DOMAINS + 1).collect()}
    if len(shares) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(shares)
    if domains:
        ids = F.broadcast(samples.sample_ids(known, per_domain))  # per_domain x domains rows at most
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")
        counted = texts.select("label", F.explode(F.transform(_words(F.col("text")), _bucket)).alias("bucket")).groupBy("bucket", "label").count().collect()
        counts = {(r.bucket, domains.index(r.label)): r["count"] for r in counted}
    workspace.drop(known)
    return _Classifier(domains, [shares[d] / sum(shares.values()) for d in domains], counts) if domains else None


def _fit(docs: DataFrame, parts: DataFrame, labelled: DataFrame, targets: dict[str, float] | None, id_col: str, text_col: str, domain_col: str, total_tokens: int | None, per_domain: int, max_steps: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Every row's cell and tokens, and the rate of every cell; the cells' number is bounded by the grid, so they may be broadcast."""
    model = _learn(docs, labelled, id_col, text_col, domain_col, per_domain)
    post = (lambda w: model.posterior(w)) if model else (lambda w: F.array().cast("array<double>"))
    scored = parts.select("*", _let(_words(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), post(w).alias("p"))).alias("s")).drop("t")
    key = F.array_join(F.transform("s.p", lambda p: F.round(p * GRID).cast("int")), "-")
    placed = workspace.materialise(scored.select(*(c for c in scored.columns if c != "s"), key.alias("cell"), F.col("s.n").alias("n_tokens"), F.col("s.p").alias("p")), "cells")
    k = len(model.domains) if model else 0
    sums = [F.sum(F.col("n_tokens") * F.get("p", F.lit(i))).alias(f"m{i}") for i in range(k)]
    cells = workspace.materialise(placed.groupBy("cell").agg(F.sum("n_tokens").alias("tokens"), *sums).coalesce(1), "table")
    whole = cells.agg(F.sum("tokens").alias("tokens"), *(F.sum(f"m{i}") for i in range(k))).first()
    total = whole[0] or 0
    if not model or not total:
        return placed, cells.select("cell", F.lit(1.0).alias("rate"))
    wanted = targets or {d: 1.0 for d in model.domains}
    weight = sum(wanted.get(d, 0.0) for d in model.domains)
    if weight <= 0:
        raise ValueError("no target weight on a known domain")
    goal = [wanted.get(d, 0.0) / weight * (total_tokens or total) for d in model.domains]
    return placed, _project(cells, goal, float(max(whole[1:])), float((total_tokens or total) / total), max_steps, tolerance)


def _project(cells: DataFrame, goal: list[float], bound: float, start: float, max_steps: int, tolerance: float) -> DataFrame:
    """Projected gradient over the cells (cell, tokens, m0, m1, ...), with momentum that starts afresh when the distance grows.

    The cells are few, so the state is one row of them and BLOCK steps are one job.
    """
    k, size = len(goal), sum(goal)
    one = F.struct("cell", F.col("tokens").cast("double").alias("t"), F.array(*(F.col(f"m{i}").cast("double") for i in range(k))).alias("m"), *(F.lit(start).alias(c) for c in ("r", "y", "best")))
    state = cells.agg(F.array_sort(F.collect_list(one)).alias("cells")).select(F.struct("cells", F.lit(1.0).alias("s"), F.lit(float("inf")).alias("last"), F.lit(float("inf")).alias("least")).alias("x"))
    adder = lambda c, i: lambda a, e: a + e[c] * e["m"][i]
    held = lambda x, c: [F.aggregate(x["cells"], F.lit(0.0), adder(c, i)) - F.lit(float(goal[i])) for i in range(k)]

    def step(x: Column, _: Column) -> Column:
        return _let(F.struct(F.array(*held(x, "r")).alias("r"), F.array(*held(x, "y")).alias("y")), lambda off: moved(x, off))

    def moved(x: Column, off: Column) -> Column:
        miss = F.sqrt(sum(off["r"][i] * off["r"][i] for i in range(k))) / F.lit(size)
        return _let(F.struct(miss.alias("miss"), (miss > x["last"]).alias("again")), lambda seen: following(x, off, seen))

    def following(x: Column, off: Column, seen: Column) -> Column:
        residual = F.when(seen["again"], off["r"]).otherwise(off["y"])
        s = F.when(seen["again"], 1.0).otherwise((1 + F.sqrt(1 + 4 * x["s"] * x["s"])) / 2)
        push = F.when(seen["again"], 0.0).otherwise((x["s"] - 1) / s)
        slope = lambda e: sum(e["m"][i] * residual[i] for i in range(k)) / F.greatest(e["t"], F.lit(1.0)) / F.lit(bound)
        new = lambda e: F.greatest(F.lit(0.0), F.when(seen["again"], e["r"]).otherwise(e["y"]) - slope(e))
        best = lambda e: F.when(seen["miss"] < x["least"], e["r"]).otherwise(e["best"])
        each = lambda e: _let(new(e), lambda r: F.struct(e["cell"].alias("cell"), e["t"].alias("t"), e["m"].alias("m"), r.alias("r"), (r + push * (r - e["r"])).alias("y"), best(e).alias("best")))
        return F.struct(F.transform(x["cells"], each).alias("cells"), s.alias("s"), seen["miss"].alias("last"), F.least(x["least"], seen["miss"]).alias("least"))

    least = math.inf
    for done in range(0, max_steps, BLOCK):
        last, state = state, workspace.materialise(state.select(F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), F.col("x"), step).alias("x")), "rates")
        if done:
            workspace.drop(last)
        was, least = least, state.select("x.least").first()[0]
        if least <= tolerance or was - least <= 1e-5 * least:
            break
    return state.select(F.explode("x.cells").alias("e")).select("e.cell", F.col("e.best").alias("rate"))


def _copies(key: Column, seed: int) -> Column:
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
