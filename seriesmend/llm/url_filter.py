"""URL filters by pattern rules that are indexed by their rarest literal token (operator 5).

A rule is written with literals, ``*`` (anything), ``^`` (a separator or an end) and, at the start, ``||`` (the host itself or any of its
subdomains). Its literal tokens are the runs of a-z and 0-9 which any matching URL has as whole tokens. How often each such token occurs in all URLs is
counted first; each rule goes under its rarest one. A URL's tokens then fetch candidate rules, and only those run their regular
expressions. Rules without such a token are always candidates.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map, worker_object

LOWER = {c: c + 32 for c in range(65, 91)}
TOKEN = re.compile("[a-z0-9]+")
#: Characters of all rules; they go to every worker.
MOST_RULES = 64 << 20
#: Patterns of the default list, by which a URL that no site rule fits is blocked.
BLOCKED = ["^ads^", "^adserver^", "^banner^", "^casino^", "^doubleclick^", "^popunder^", "^porn^", "^tracking^", "^viagra^", "^xxx^", "/cgi-bin/*spam", "/wp-login.php^"]


@dataclass(frozen=True)
class Rule:
    """pattern: see above; verdict: allow or block; name: what is reported of a site rule, None for the method's own patterns."""

    pattern: str
    verdict: str
    name: str | None = None


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """The rule for a host, its subdomains, and paths that start with path."""
    return Rule(f"||{host}{path}", verdict, host + path)


def compiled(pattern: str) -> re.Pattern:
    """The regular expression of a pattern, for a host (lower case) followed by a path."""
    site = pattern.startswith("||")
    out = ""
    for c in pattern[2 * site :]:
        out += ".*" if c == "*" else "(?:[^A-Za-z0-9]|$|(?<![A-Za-z0-9]))" if c == "^" else re.escape(c)
    return re.compile((r"(?:[^/?#]*\.)?" if site else ".*?") + out, re.DOTALL)


def tokens(pattern: str) -> list[str]:
    """Whole tokens of every URL that matches the pattern: literal runs between separators or at the start of a host."""
    site = pattern.startswith("||")
    body = pattern[2 * site :].translate(LOWER)
    whole = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else "/" if site else "*"
        after = body[m.end()] if m.end() < len(body) else "*"
        if before != "*" and after != "*":
            whole.append(m[0])
    return whole


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): what follows the first ://, up to / ? # with A-Z lower-cased, then up to ? or #; both empty without a ://."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class RuleIndex:
    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            own = tokens(r.pattern)
            entry = (r, compiled(r.pattern))
            (self.by_token[min(own, key=lambda t: (frequency.get(t, 0), t))] if own else self.always).append(entry)

    def candidates(self, host: str, path: str) -> list:
        found = list(self.always)
        for t in set(TOKEN.findall((host + path).translate(LOWER))):
            found += self.by_token.get(t, ())
        return found

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(name of the longest site rule that fits, its verdict), or (None, block if a pattern matches, else allow)."""
        best, verdict = None, "allow"
        if not host and not path:
            return None, verdict
        for r, match in self.candidates(host, path):
            if match.match(host + path):
                if r.name is None:
                    verdict = "block" if best is None and r.verdict == "block" else verdict
                elif best is None or (len(r.name), best) > (len(best), r.name):
                    best, verdict = r.name, r.verdict
        return best, verdict


def index(rules) -> RuleIndex:
    return worker_object("rules", rules.value, lambda: RuleIndex(list(rules.value[0]), dict(rules.value[1])))


def pattern_rules(patterns: DataFrame, column: str = "pattern") -> list[Rule]:
    """Block rules of a table of patterns (nulls and repeats go). ValueError if they are too many to send to the workers."""
    rows = patterns.select(F.col(column).alias("pattern")).where("pattern is not null").distinct()
    if (rows.agg(F.sum(F.length("pattern"))).first()[0] or 0) > MOST_RULES:
        raise ValueError(f"patterns of over {MOST_RULES} characters; deal them into lists by site and join by host")
    return [Rule(r[0], "block") for r in rows.orderBy("pattern").collect()]


def filter_urls(pages: DataFrame, site_rules: list[Rule], patterns: list[Rule] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (the longest site rule that fits, else null), verdict (allow or
    block: the rule's; without one, block if any of `patterns` matches, else allow). patterns: rules, or a table with a column `pattern`; a short list by default.

    A null url or one without :// has an empty host and path, which no rule fits: allow. Null ids stay, repeated rows are judged each; of site rules of one
    length the first by name wins; an empty table gives an empty one; without rules all is allowed. Other columns, whatever their names, aren't read.
    """
    if isinstance(patterns, DataFrame):
        patterns = pattern_rules(patterns)
    rules = [*site_rules, *([Rule(p, "block") for p in BLOCKED] if patterns is None else patterns)]
    if sum(len(r.pattern) for r in rules) > MOST_RULES:
        raise ValueError(f"rules of over {MOST_RULES} characters; deal them into lists by site and join by host")
    known = {t for r in rules for t in tokens(r.pattern)}

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for url in b.column(0).to_pylist():
                seen.update(t for t in set(TOKEN.findall("".join(parts(url)).translate(LOWER))) if t in known)
        yield {"token": list(seen), "n": list(seen.values())}

    counted = arrow_map(pages.select(url_col), count, T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    frequency = counted.groupBy("token").agg(F.sum("n")).collect()  # at most a row for each token of the rules
    shared = pages.sparkSession.sparkContext.broadcast((tuple(rules), tuple(sorted((t, n) for t, n in frequency))))
    fields = [T.StructField("page_id", pages.schema[id_col].dataType)] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]

    def judge(batches):
        for b in batches:
            rows = [(h, p, *index(shared).judge(h, p)) for h, p in map(parts, b.column(1).to_pylist())]
            yield {"page_id": b.column(0), **{f.name: [r[k] for r in rows] for k, f in enumerate(fields[1:])}}

    return arrow_map(pages.select(id_col, url_col), judge, T.StructType(fields))
