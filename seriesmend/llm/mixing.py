"""Mixing sources to target weights by soft membership (operator 2), with DataFrame functions only.

A classifier learned from a table of labelled documents gives every text its posterior over domains. Then projected-gradient least squares
finds a rate r >= 0 for each document such that the expected tokens of each domain, the sum of r x tokens x posterior, are the
domain's target. With e_d the excess of domain d over its target and a_d its tokens at rate 1, a step is

    r <- max(0, r - sum_d p_d e_d / a_d)

which is the gradient of sum_d e_d^2 / (2 a_d) in the metric of the documents' tokens. Steps are scaled by the D x D curvature over the
rates above 0, with as much damping as the squares' fall needs, and end where a plain step no longer moves the rates, which is the optimum's condition.

A rate depends on the posterior and on the moves alone. So no rate is ever kept: the D numbers of each step are, and a rate is their fold,
worked out where it is needed. A step is one aggregate over cells of equal posteriors (rounded to DIGITS) whose few sums reach the driver.

The classifier is naive Bayes in two parts. Domains without a target (toxic) are told from the others by words alone, runs of letters in
lower case, so that marks of low quality can't outvote them; words that don't tell count too, as a long text has a telling word by
chance. The others are told apart by words and three traits of the whole text (shares of repeated words, of symbols and of capitals, in
bins). It learns from at most ``max_labelled`` labelled rows, equal texts once. Whole texts are judged where they are read; words are
never shuffled but for those of labelled texts.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.runtime import columns_of, discard, shared_dir, unused, written

MAX_LABELLED = 10_000
#: A word tells a domain if LEAST_TEXTS labelled texts have it; if in the domain LEAST_SHARE of the texts have it or, at the mean share,
#: would; if its log odds there are LEAST_ODDS at least (MOST_ODDS is what it counts at most); and if the squared deviation of its texts
#: from what is expected is LEAST_CHI at least in terms of that.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, MOST_ODDS, LEAST_CHI = 5, 0.01, 2.0, 4.0, 36.0
DIGITS = 3
#: Steps end when one moves the rates by less than TOLERANCE of the target tokens in all.
STEPS, TOLERANCE = 200, 1e-5
#: Cells of which rates are broadcast; with more, each row folds its own rate.
MOST_CELLS = 100_000
#: Repeated rows that are dealt as one, about.
GROUP = 100_000
#: Targets in all are this much over the least total at which no domain with a target loses tokens.
HEADROOM = 1.02
SYMBOLS = "!#$%&*|=<>@^~"


def letter_words(text: Column) -> Column:
    """The distinct runs of letters of a text, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")


def space_words(text: Column) -> Column:
    """What stands between spaces, tabs and line ends."""
    for end in "\n\t\r":
        text = F.replace(text, F.lit(end), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def traits(text: Column, words: Column) -> list[Column]:
    """Words that stand for traits of a whole text. words: its space_words."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda part: F.least(F.lit(9), F.floor(10 * part)).cast("string")
    repeated = 1 - F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")) / n
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")) / n
    return [F.concat(F.lit(f"\n {name} "), share(part)) for name, part in (("repeated", repeated), ("symbols", symbols), ("capitals", capitals))]


@dataclass
class Classifier:
    """Domains by name; those without a target (unwanted), if there are both kinds. words: of each word or trait that tells, its log odds
    for the unwanted domains as a whole, then its score for each domain within its own kind."""

    domains: list[str]
    unwanted: list[int] = field(default_factory=list)
    words: dict[str, list[float]] = field(default_factory=dict)
    prior: list[float] = field(default_factory=list)
    bad_prior: float = 0.0
    other: float = 0.0


def _tells(inside: Column, texts: Column, mine: float, rest: float) -> tuple[Column, Column]:
    """(log odds of a word in `mine` texts against `rest`, whether it tells)."""
    fair = texts * (mine / max(mine + rest, 1))
    odds = F.log((inside + 0.5) / (mine + 1.0)) - F.log((texts - inside + 0.5) / (rest + 1.0))
    enough = (texts >= LEAST_TEXTS) & (F.greatest(inside, fair) >= LEAST_SHARE * mine)
    return odds, enough & (F.abs(odds) >= LEAST_ODDS) & ((inside - fair) ** 2 / fair >= LEAST_CHI)


def learn(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Classifier:
    """The classifier of the domains in labelled (id, domain) and in targets, from docs' texts of those ids."""
    shared_dir(docs.sparkSession)
    named = labelled.select(F.col("id").alias("id"), F.col("domain").alias("domain")).where("id is not null and domain is not null")
    chosen = written(named.orderBy(F.xxhash64("id", "domain"), "id", "domain").limit(max_labelled), "labelled")  # at most max_labelled rows of two values
    domains = sorted({r[0] for r in named.select("domain").distinct().collect()} | set(targets))
    unwanted = [k for k, d in enumerate(domains) if targets.get(d, 0.0) <= 0]
    model = Classifier(domains, unwanted if len(unwanted) < len(domains) else [])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("domain", F.md5(F.col("text").cast("binary")).alias("key"), "text", space_words(F.col("text")).alias("words"))
    every = F.concat(letter_words(F.col("text")), F.array(*traits(F.col("text"), F.col("words"))))
    # no text is without traits; the outer form keeps a filter on them from being inferred, which would judge all texts below the join
    has = written(rows.select("domain", "key", F.explode_outer(every).alias("word")).distinct(), "labelled-words")
    seen = {r["domain"]: r["n"] for r in has.select("domain", "key").distinct().groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [seen.get(d, 0) for d in domains]
    kinds = [k for k in ([i for i in range(len(n)) if i not in model.unwanted], model.unwanted) if k]
    of = {i: kind for kind in kinds for i in kind}
    model.prior = [log((n[i] + 1) / (sum(n[j] for j in of[i]) + len(of[i]))) for i in range(len(n))]
    bad, good = sum(n[i] for i in model.unwanted), sum(n) - sum(n[i] for i in model.unwanted)
    model.bad_prior = log((bad + 1) / (good + 1))
    by = has.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    by = written(by.where(" + ".join(f"n{k}" for k in range(len(n))) + f" >= {LEAST_TEXTS}"), "word-counts")
    count = lambda some: sum([F.col(f"n{i}") for i in some], F.lit(0))
    trait = F.col("word").startswith("\n")
    columns, tells = [], F.lit(False)
    if bad and good:
        odds, bad_tells = _tells(count(model.unwanted), count(range(len(n))), bad, good)
        bad_tells = bad_tells & ~trait
        columns.append(F.when(bad_tells, F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), odds))).otherwise(0.0).alias("bad"))
        tells = tells | bad_tells
    else:
        columns.append(F.lit(0.0).alias("bad"))
    for i in range(len(n)):
        mine, whole = n[i], sum(n[j] for j in of[i])
        known = F.lit(False)
        for j in of[i]:  # a word that tells one domain of a kind scores for each of them
            if 0 < n[j] < whole:
                known = known | _tells(F.col(f"n{j}"), count(of[i]), n[j], whole - n[j])[1]
        score = F.log((F.col(f"n{i}") + 0.5) / (mine + 1.0)) - F.log((count(of[i]) + 0.5) / (whole + 1.0))
        columns.append(F.when(known, F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), score))).otherwise(0.0).alias(f"w{i}"))
        tells = tells | known
    told = by.where(tells).select("word", *columns, count(model.unwanted).alias("inside"), count(range(len(n))).alias("texts")).orderBy("word").collect()
    model.words = {r["word"]: [r["bad"], *[r[f"w{i}"] for i in range(len(n))]] for r in told}
    if bad and good:
        whole, within = (x or 0 for x in has.where(~trait).agg(F.count("*"), F.count_if(F.col("domain").isin([domains[i] for i in model.unwanted]))).first())
        hits, ours = (sum(r[c] for r in told if r["bad"] > 0) for c in ("texts", "inside"))
        share = lambda part, whole: (part + 0.5) / (whole + 1.0)
        model.other = log((1 - share(ours, within)) / (1 - share(hits - ours, whole - within)))
    discard(chosen, has, by)
    return model


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str, tokens: str = "tokens", p: str = "p") -> DataFrame:
    """docs with tokens (words of the text) and p0, p1, ... (rounded to DIGITS), by the row: no word leaves its task. docs must not have columns of these names."""
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")  # noqa: E731  folded once, when the plan is made
    d = range(len(model.domains))
    told = constant(list(model.words), "string")
    text, words, letters, hits, scores = (unused(docs, x) for x in ("mix_text", "mix_words", "mix_letters", "mix_hits", "mix_scores"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumns({words: space_words(F.col(text)), letters: letter_words(F.col(text))})
    found = F.array_intersect(F.concat(F.col(letters), F.array(*traits(F.col(text), F.col(words)))), told)
    places = F.transform(found, lambda w: F.array_position(told, w).cast("int") - 1)
    rows = rows.select(*columns_of(docs), F.size(words).cast("long").alias(tokens), F.size(letters).alias(letters), places.alias(hits))
    total = lambda k, first: F.aggregate(hits, first, _adding(constant([w[k] for w in model.words.values()], "double")))
    bad = total(0, F.lit(float(model.bad_prior))) + F.lit(float(model.other)) * F.col(letters)
    rows = rows.select(*columns_of(docs), tokens, F.array(bad, *[total(k + 1, F.lit(float(model.prior[k]))) for k in d]).alias(scores))
    at = lambda k: F.get(scores, F.lit(k))
    share = {}
    for kind, sign in (([k for k in d if k not in model.unwanted], 1), (model.unwanted, -1)):
        if not kind:
            continue
        top = F.greatest(*[at(k + 1) for k in kind]) if len(kind) > 1 else at(kind[0] + 1)
        weight = [F.exp(at(k + 1) - top) for k in kind]
        whole = sum(weight[1:], weight[0])
        part = 1 / (1 + F.exp(sign * at(0))) if model.unwanted else F.lit(1.0)
        share |= {k: w / whole * part for k, w in zip(kind, weight, strict=True)}
    return rows.select(*columns_of(docs), tokens, *[F.round(share[k], DIGITS).alias(f"{p}{k}") for k in d])


def _adding(values: Column):
    return lambda total, i: total + F.get(values, i)


def _folded(p: list[str], moves: list[list[float]]) -> str:
    """SQL of (rate, the rate before the last move, where the plain step would have gone from there). moves: D numbers by domain, then those of the plain step.

    As text: a Column costs the driver a call for each of its parts. As one literal array: numbers in the expressions would make each step another program to compile.
    """
    change, plain = (" + ".join(f"`{x}` * get(m, {k + first})" for k, x in enumerate(p)) for first in (0, len(p)))
    told = f"from_json('{json.dumps(moves)}', 'array<array<double>>')"
    state = f"struct(greatest(0.0D, s.rate - ({change})) AS rate, s.rate AS was, greatest(0.0D, s.rate - ({plain})) AS plain)"
    return f"aggregate({told}, struct(1.0D AS rate, 1.0D AS was, 1.0D AS plain), (s, m) -> {state})"


@dataclass
class Solution:
    """moves: of each step, by domain, and beside it the plain gradient step. targets and expected: tokens by domain; residual: the absolute differences' sum as a share of all
    target tokens; settled: whether the optimum's condition holds."""

    moves: list[list[float]]
    targets: list[float]
    expected: list[float]
    residual: float
    settled: bool

    def rate(self, p: list[str]) -> Column:
        """The rate of a row with these columns of posteriors."""
        return F.expr(_folded(p, self.moves) + ".rate")


def solve(cells: DataFrame, shares: list[float], total: float | None = None, most: int = STEPS) -> Solution:
    """Least squares over cells (p0, p1, ..., tokens), by projected gradient steps in the metric of the curvature over the rates above 0, damped
    as far as the squares fall. It ends where a plain gradient step no longer moves the rates."""
    d = range(len(shares))
    p = [f"p{k}" for k in d]

    def state(moves: list[list[float]]) -> tuple[list[float], list[list[float]], float]:
        """(expected tokens, curvature, tokens that the plain step in place of the last would have moved)."""
        at = cells.selectExpr(*p, "tokens", f"{_folded(p, moves)} AS s").selectExpr(*p, "tokens", "s.rate", "s.was", "s.plain")
        sums = ["sum(tokens * abs(was - plain))", *[f"sum(tokens * rate * {x})" for x in p]]
        sums += [f"sum(if(rate > 0, tokens, 0.0D) * p{i} * p{j})" for i in d for j in range(i + 1)]
        row = [float(x or 0) for x in at.agg(*map(F.expr, sums)).first()]
        bent, half = [[0.0] * len(d) for _ in d], iter(row[1 + len(d) :])
        for i in d:
            for j in range(i + 1):
                bent[i][j] = bent[j][i] = next(half)
        return row[1 : 1 + len(d)], bent, row[0]

    have, bent, _ = state([])
    if total is None:
        total = HEADROOM * max((a / s for a, s in zip(have, shares, strict=True) if s > 0 and a > 0), default=0.0)
    total = float(total)
    targets = [s * total for s in shares]
    known = [k for k in d if have[k] > 0]
    squares = lambda now: sum((now[k] - targets[k]) ** 2 / have[k] for k in known)
    moves: list[list[float]] = []
    now, damping, settled = have, 0.1, not known
    for _ in range(most if known else 0):
        excess = {k: now[k] - targets[k] for k in known}
        found = _solved([[bent[i][j] + (damping * have[i] if i == j else 0.0) for j in known] for i in known], [excess[k] for k in known])
        move = [dict(zip(known, found, strict=True)).get(k, 0.0) for k in d] + [excess[k] / have[k] if k in excess else 0.0 for k in d]
        then, then_bent, far = state([*moves, move])
        if far <= TOLERANCE * max(total, 1.0):
            settled = True
            break
        if squares(then) < squares(now):
            moves, now, bent, damping = [*moves, move], then, then_bent, max(damping / 3, 1e-9)
        elif damping > 1e6:
            break  # rounding errors are all that is left
        else:
            damping *= 2
    return Solution(moves, targets, now, sum(abs(x - t) for x, t in zip(now, targets, strict=True)) / max(total, 1e-300), settled)


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, for a symmetric matrix with a positive diagonal that outweighs rounding (Gauss)."""
    rows = [[*r, y] for r, y in zip(a, b, strict=True)]
    for i in range(len(rows)):
        best = max(range(i, len(rows)), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        rows = [r if k == i else [x - r[i] * y for x, y in zip(r, rows[i], strict=True)] for k, r in enumerate(rows)]
    return [r[-1] for r in rows]


def rates(rows: DataFrame, model: Classifier, targets: Mapping[str, float], tokens: str, p: str, rate: str, total: float | None = None) -> tuple[DataFrame, Solution]:
    """(rows with their rate, the solution). rows: written, with tokens and posteriors."""
    names = [f"{p}{k}" for k in range(len(model.domains))]
    keys = [F.col(x) for x in names]
    whole = sum(max(x, 0.0) for x in targets.values()) or 1.0
    cells = rows.groupBy(*[x.alias(f"p{k}") for k, x in enumerate(keys)]).agg(F.sum(tokens).cast("double").alias("tokens"))
    cells = written(cells, "cells")
    few = cells.count() <= MOST_CELLS
    cells = written(cells.coalesce(1), "cells") if few else cells  # each step reads them
    found = solve(cells, [max(targets.get(d, 0.0), 0.0) / whole for d in model.domains], total)
    if not found.settled:
        warnings.warn(f"rates didn't settle: expected tokens are {found.residual:.1%} of the total off their targets", stacklevel=3)
    if not few:
        return rows.withColumn(rate, found.rate(names)), found
    mine = [unused(rows, f"mix_cell{k}") for k in range(len(keys))]
    rated = cells.select(*[F.col(f"p{k}").alias(c) for k, c in enumerate(mine)], found.rate([f"p{k}" for k in range(len(keys))]).alias(rate))
    same = [x == F.col(c) for x, c in zip(keys, mine, strict=True)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.join(F.broadcast(rated), on, "left").drop(*mine), found


def with_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row for each row of docs: doc_id, tokens, domain (the likeliest; the first by name of equals), posterior (map), rate, and of that
    domain target_tokens and expected_tokens (what all rates give it), and residual (by how much all expected tokens miss their targets,
    as a share of the total). A solution that didn't settle is warned of.

    labelled: (id, domain); ids that docs lacks, null ids and null domains teach nothing. targets: share of tokens for each domain; they are
    scaled to 1, and a domain without one has 0. total: target tokens in all; by default the least total at which every domain with a target
    keeps its tokens, times HEADROOM. Null texts are empty: no tokens and the posterior of their traits. Null ids and repeated rows stay;
    without labelled rows all posteriors are equal; an empty table gives an empty one; other columns, whatever their names, aren't read.
    """
    model = learn(docs, labelled, targets, id_col, text_col, max_labelled)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, found = rates(written(with_posteriors(slim, model, "text").drop("text"), "posteriors"), model, targets, "tokens", "p", "rate", total)
    p = [F.col(f"p{k}") for k in range(len(model.domains))]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    first = lambda values: F.coalesce(*[F.when(x == best, F.lit(v)) for x, v in zip(p, values, strict=True)])
    posterior = F.create_map(*[y for x, d in zip(p, model.domains, strict=True) for y in (F.lit(d), x)])
    sums = (F.round(first(x), 3).alias(name) for x, name in ((found.targets, "target_tokens"), (found.expected, "expected_tokens")))
    return rows.select("doc_id", "tokens", first(model.domains).alias("domain"), posterior.alias("posterior"), F.round("rate", 6).alias("rate"), *sums, F.lit(round(found.residual, 6)).alias("residual"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", seed: int = 11, least: int = 0, total: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with each row as often as its rate says: the whole part of the rate, and once more with the chance of the rest (drawn by a hash
    of id, text and seed). All columns stay. least: rows that likelier are of a domain with a target than not come as often at least, and
    with it the others don't come. Rows of one id and text are dealt as one: n of them give floor(n x rate + draw) in all, spread evenly (in parts of about GROUP, each with a draw of its own, where there are more). See with_rates."""
    model = learn(docs, labelled, targets, id_col, text_col, max_labelled)
    tokens, rate, times, one, key, file, row, place = (unused(docs, f"mix_{x}") for x in ("tokens", "rate", "times", "one", "key", "file", "row", "place"))
    p = "mix_p"
    while any(unused(docs, f"{p}{k}") != f"{p}{k}" for k in range(len(model.domains))):
        p = "_" + p
    # texts go along, so that they are judged once
    judged = written(with_posteriors(docs, model, text_col, tokens, p).withColumn(key, F.xxhash64(id_col, text_col)), "posteriors")
    repeated = written(judged.groupBy(key).agg(F.count("*").alias(place)).where(F.col(place) > 1).withColumnRenamed(key, one), "repeated-rows")
    some = not repeated.isEmpty()
    rows, _ = rates(judged.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")}) if some else judged, model, targets, tokens, p, rate, total)
    drawn = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    once = lambda df: df.withColumn(times, F.floor(F.col(rate) + drawn(id_col, text_col)).cast("int"))
    if some:
        part = F.pmod(F.xxhash64(file, row), F.ceil(F.col(place) / GROUP))
        more = rows.join(repeated, F.col(key) == F.col(one)).withColumn(one, part)
        more = more.withColumn(place, F.row_number().over(Window.partitionBy(key, one).orderBy(file, row)))
        draw = F.when(F.col(one) == 0, drawn(id_col, text_col)).otherwise(drawn(id_col, text_col, one))
        upto = lambda n: F.floor(n * F.col(rate) + draw)
        more = more.withColumn(times, (upto(F.col(place)) - upto(F.col(place) - 1)).cast("int")).drop(one, place)
        rows = once(rows.join(repeated, F.col(key) == F.col(one), "left_anti")).unionByName(more)
    else:
        rows = once(rows)
    keys = [(F.col(f"{p}{k}"), targets.get(d, 0.0) > 0) for k, d in enumerate(model.domains)]
    whole = lambda wanted: sum([x for x, w in keys if w == wanted], F.lit(0.0))
    often = F.col(times)
    rows = rows.withColumn(times, F.when(whole(True) > whole(False), F.greatest(F.lit(least), often)).otherwise(F.lit(0) if least else often)).where(F.col(times) > 0)
    return rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns_of(docs))
