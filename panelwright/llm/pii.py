"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated by
expectation-maximisation, and a span classifier is trained on the resulting posteriors.

Candidates are the base matches of each kind (always returned), the matches that the base rules
drop, and matches of loose forms in what the base spans leave of the text: obfuscated addresses,
grouped card numbers and national telephone numbers among them. What a kind is by definition
(Luhn, ranges, numbers of digits) is checked; a candidate that fails is a known negative: it is
never returned, and the false-alarm rates are learned from it. Five labelers vote for, against or
not at all on each candidate: the form (regex), a gazetteer (top-level domains, dialling codes,
card issuers, reserved networks), cue words before and after, the neighbouring words, and the
characters at its edges. Each has its own rates in each kind, of voting for true spans and for
false ones. A third of a rate's weight stays with its first guess, and an against vote is held to
be at least three times as likely for a false span; so a labeler can't change sides, whatever the corpus.

Votes are counted over all documents; there are at most 8 * 3**5 vote patterns, and only their
counts reach the driver. The classifier is a logistic regression on each kind's votes, with
weights of at least 0 for votes for and at most 0 for votes against; it is fitted to the
posteriors on that table. A candidate that passes its check and is no base match is added where
the classifier gives it 0.5 or more.

Built-in SQL functions only. A text is scanned once a kind for a mark of it, and where it has the
mark twice a pattern (the matches, and the pieces between them); what is found is staged, a narrow
row a document. The base patterns start only where a run of their characters starts and don't
backtrack into it, positions are summed in blocks, and contexts are cut from the pieces between
the matches, so the work is close to linear in the text.

Defined results: null text counts as empty; documents without spans have counts of 0, the hash of
the empty string and an empty list. Without any candidate nothing is trained or added. Rows with
equal or null ids are each returned. Other columns are ignored. Added spans of two kinds may
overlap each other, but no base span.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, own, starts
from .staging import Staging

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the base rules, with starts at a run's start and possessive repeats.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose forms, looked for where no base span is.
_AT, _DOT = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
_POINT = r"(?:\.|\[\.\]|\(\.\)|\x20?[\[(]dot[\])]\x20?)"
LOOSE = {
    "email": rf"(?<![{LOCAL}])[A-Za-z0-9][{LOCAL}]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([\x20./_-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: A text without the mark has no base match, or no loose one.
MARK = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]{2}", "phone": r"\+[0-9]"}
LOOSE_MARK = {
    "email": r"[\[({]at[\])}]|\x20at\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]|\x20?[\[({]dot|\x20dot\x20)",
    "ip": r"[0-9](?:\.|[\[(]\.|\x20?[\[(]dot)[\])]?\x20?[0-9]",
    "card": r"[0-9]{4}[\x20./_-]?[0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-]?[0-9]{4}",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

# Gazetteers and cue words, fixed values.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|eu|uk|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ie|us|ca|mx|br|ar|in|cn|jp|kr|au|nz|za|ru|example|test"
DIALLING = "1|7|20|27|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62|35"
RESERVED = r"0*(?:0|10|127)\.|0*169\.0*254\.|0*192\.0*168\.|0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|0*(?:22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": ("e-?mail|contact|write|reply|courriel|correo|kontakt", "regex|pattern|format|look(?:ed|ing)?|arrived?"),
    "ip": ("ip|address|host|server|client|login|adresse", "version|release|build|section|chapter"),
    "card": ("card|credit|visa|pay|carte|karte|tarjeta|konto", "isbn|sku|serial|order|tracking|token"),
    "phone": ("tel|phone|call|fax|mobile|contact|telefon|llame", "score|total|sum|plus|isbn|serial"),
}
BEFORE, AFTER = 48, 32
VOTES = ("form", "gazetteer", "cue", "words", "edges")
#: First guesses: how often a labeler that votes does so for a true span, and for a false one.
GUESS = {"form": (0.9, 0.4), "gazetteer": (0.9, 0.4), "cue": (0.9, 0.1), "words": (0.8, 0.4), "edges": (0.95, 0.4)}
#: Pseudo-counts of a guess, and its weight as a share of the votes seen.
PSEUDO, SHARE = 8.0, 0.5
#: The first guess of a kind's prior, and the most it may become: most candidates are base matches, which says little of the others.
PRIOR, MOST = 0.7, 0.8
#: An against vote is at least so many times likelier for a false span than for a true one.
LEAST = 3.0
ROUNDS, EPOCHS = 40, 400

_SPAN = "struct<s:int,e:int,v:string,b:string,a:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(text: str, pattern: str) -> str:
    """SQL for the matches in order: where each starts and ends in code points, itself, and what stands before and after."""
    p = _quoted(pattern)
    cut = f"""transform(m, (v, i) -> named_struct('s', z[i] + length(p[i]), 'e', z[i] + length(p[i]) + length(v), 'v', v, 'b', right(p[i], {BEFORE}), 'a', left(p[i + 1], {AFTER})))"""
    placed = let(starts("transform(m, (v, i) -> length(p[i]) + length(v))"), "z", cut)
    return let(f"regexp_extract_all({text}, {p}, 0)", "m", let(f"split({text}, {p}, -1)", "p", placed))


def _masked(text: str, pattern: str, kind: str) -> str:
    """SQL for the text with the valid matches replaced by as many code points of U+0001."""
    p = _quoted(pattern)
    body = f"array_join(transform(p, (x, i) -> if(i >= size(m), x, concat(x, if({_valid(kind, 'm[i]')}, repeat('\\u0001', length(m[i])), m[i])))), '')"
    return let(f"regexp_extract_all({text}, {p}, 0)", "m", let(f"split({text}, {p}, -1)", "p", body))


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    d = f"reverse({_digits(v)})"
    digit = f"cast(substr({d}, at, 1) as int)"
    return f"(aggregate(sequence(1, length({d})), 0, (t, at) -> t + case when at % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end) % 10 = 0)"


def _valid(kind: str, v: str) -> str:
    """SQL for the base rule's check of a match."""
    return {
        "email": "true",
        "ip": f"{v} rlike {_quoted(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
        "card": f"(length({_digits(v)}) between 12 and 19 and {_luhn(v)})",
        "phone": f"length({_digits(v)}) between 9 and 15",
    }[kind]


def plain(kind: str, v: str) -> str:
    """SQL for a loose match of an address written out: brackets, blanks and words for marks undone."""
    if kind == "email":
        return f"regexp_replace(regexp_replace({v}, {_quoted(_AT)}, '@'), {_quoted(_DOT)}, '.')"
    return f"regexp_replace({v}, {_quoted(_POINT)}, '.')" if kind == "ip" else v


def _passes(kind: str, v: str) -> str:
    """SQL for the check of a loose match, on its plain form."""
    return f"({v} rlike '^[^@]{{1,64}}@[^@]{{1,250}}[.][A-Za-z]{{2,}}$')" if kind == "email" else _valid(kind, v)


def _votes(kind: str) -> str:
    """SQL for the votes on x (s, e, v, b, a), as array<int>."""
    say = lambda yes, no: f"case when {yes} then 1 when {no} then -1 else 0 end"
    like = lambda of, pattern: f"{of} rlike {_quoted(pattern)}"
    v = f"({plain(kind, 'x.v')})"
    form = {
        "email": say(like(v, r"^[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$") + " and not " + like("x.v", r"\x20at\x20"), "true"),
        "ip": say(like(v, r"^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$"), "true"),
        "card": say(like("x.v", r"^([0-9]{4}([\x20-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{12,19})$"), "true"),
        "phone": say(like("x.v", r"^([+]|00)[0-9]{1,3}[\x20.-]?[(]?[0-9]{1,4}[)]?([\x20.-]?[0-9]{2,4}){2,4}$|^[(][0-9]{2,4}[)]"), "true"),
    }[kind]
    gazetteer = {
        "email": say(like(f"lower({v})", rf"[.]({DOMAINS})$"), "true"),
        "ip": say("not " + like(v, f"^({RESERVED})"), "true"),
        "card": say(like("x.v", f"^({ISSUERS})"), "true"),
        "phone": say(like("x.v", r"^([+]|00)") + " and " + like(f"regexp_replace({_digits('x.v')}, '^00', '')", f"^({DIALLING})"), like("x.v", r"^[+]0|^[0-9(]")),
    }[kind]
    yes, no = (f"(^|[^\\p{{L}}])({words})(?![\\p{{L}}])" for words in CUES[kind])
    around = "lower(concat(x.b, ' ', x.a))"
    cue = say(f"{like(around, yes)} and not {like(around, no)}", f"{like(around, no)} and not {like(around, yes)}")
    odd = like("x.b", r"[0-9=_/\\][^\s]*\s*$") + " or " + like("x.a", r"^\s*[^\s]*[0-9=_/\\]")
    words = say(f"not ({odd})", "true")
    edges = say(like("x.b", r"(^|[\s(<\[\"':;,|\x01])$") + " and " + like("x.a", r"^($|[\s)>\]\"':;,.!?|\x01])"), like("x.b", r"[0-9A-Za-z=/_.-]$") + " or " + like("x.a", r"^([0-9A-Za-z=/_]|[.-][0-9A-Za-z])"))
    return f"array({form}, {gazetteer}, {cue}, {words}, {edges})"


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base, more and lost: arrays of (s, k, e, kind, votes); ``lost`` failed their checks."""
    rows = docs.select(own(docs, id_col).alias("doc_id"), F.coalesce(own(docs, text_col).cast("string"), F.lit("")).alias("text"))
    none = f"cast(array() as array<{_SPAN}>)"
    sought = lambda of, mark, pattern: F.expr(f"if({of} rlike {_quoted(mark)}, {_found(of, pattern)}, {none})")
    rows = rows.withColumns({f"raw_{kind}": sought("text", MARK[kind], BASE[kind]) for kind in KINDS})
    rest = "text"
    for kind in KINDS:
        rows = rows.withColumn(f"rest_{kind}", F.expr(f"if(size(raw_{kind}) > 0, {_masked(rest, BASE[kind], kind)}, {rest})"))
        rest = f"rest_{kind}"
    rows = rows.withColumns({f"loose_{kind}": sought(rest, LOOSE_MARK[kind], LOOSE[kind]) for kind in KINDS})
    parts: dict[str, list[Column]] = {"base": [], "more": [], "lost": []}
    for k, kind in enumerate(KINDS):
        told = f"x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{kind}', 'votes', {_votes(kind)})"
        good, fine = _valid(kind, "x.v"), _passes(kind, f"({plain(kind, 'x.v')})")
        parts["base"].append(F.expr(f"transform(filter(raw_{kind}, x -> {good}), {told})"))
        parts["more"].append(F.expr(f"transform(filter(loose_{kind}, x -> {fine}), {told})"))
        parts["lost"] += [F.expr(f"transform(filter(raw_{kind}, x -> not ({good})), {told})"), F.expr(f"transform(filter(loose_{kind}, x -> not ({fine})), {told})")]
    return rows.select("doc_id", *[F.concat(*of).alias(name) for name, of in parts.items()])


#: A vote pattern: the kind, whether the check was passed, the votes, and how many candidates have them.
Pattern = tuple[str, bool, list[int], int]


def estimate(counts: list[Pattern]) -> list[float]:
    """Posteriors of being personal data for vote patterns, by EM; 0 for those that fail their checks.

    Labelers err independently given the truth; in each kind each has one rate of voting for among
    true spans and one among false ones, where it votes at all. Kinds have priors of their own.
    """
    post = [0.0] * len(counts)
    for kind in KINDS:
        own = [i for i, c in enumerate(counts) if c[0] == kind]
        rates = [GUESS[name] for name in VOTES]
        prior = PRIOR
        for _ in range(ROUNDS):
            for i in own:
                _, passed, votes, _m = counts[i]
                if passed:
                    odds = math.log(prior / (1 - prior)) + sum(math.log(t / f if v > 0 else (1 - t) / (1 - f)) for v, (t, f) in zip(votes, rates, strict=True) if v)
                    post[i] = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
            for j, name in enumerate(VOTES):
                sums = []
                for guess, weigh in ((GUESS[name][0], lambda i: post[i]), (GUESS[name][1], lambda i: 1 - post[i])):
                    cast = [(weigh(i) * counts[i][3], counts[i][2][j]) for i in own if counts[i][2][j]]
                    seen = sum(w for w, _ in cast)
                    held = PSEUDO + SHARE * seen
                    sums.append((sum(w for w, v in cast if v > 0) + held * guess, seen + held))
                (a, n), (b, m) = sums
                rates[j] = (max(a / n, 1 - (1 - b / m) / LEAST), b / m)
            passed = [i for i in own if counts[i][1]]
            seen = sum(counts[i][3] for i in passed)
            prior = min(MOST, (sum(post[i] * counts[i][3] for i in passed) + 10 * PRIOR) / (seen + 10))
    return post


def train(counts: list[Pattern], post: list[float]) -> dict[str, float]:
    """Weights of a logistic regression on each kind's votes for and against, fitted to the posteriors of what passed its check."""
    rows = [([kind, *(f"{kind} {name}{'+' if v > 0 else '-'}" for name, v in zip(VOTES, votes, strict=True) if v)], p, m) for (kind, passed, votes, m), p in zip(counts, post, strict=True) if passed]
    names = sorted({f for row, _, _ in rows for f in row})
    if not names:
        return {}
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (row, _, _) in enumerate(rows):
        x[i, [place[f] for f in row]] = 1
    y, m = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], float)
    pace = 0.6 / (x.T @ m + 1)  # a row has at most a bias and five votes
    sign = np.array([1 if f.endswith("+") else -1 if f.endswith("-") else 0 for f in names])
    w = np.zeros(len(names))
    for _ in range(EPOCHS):
        off = (1 / (1 + np.exp(-np.clip(x @ w, -500, 500))) - y) * m
        w -= pace * (x.T @ off + 0.01 * w)
        w = np.where(sign * w < 0, 0.0, w)
    return dict(zip(names, w.tolist(), strict=True))


def _score(weights: dict[str, float]) -> str:
    """SQL for the classifier's log-odds of x."""
    of = lambda kind: " + ".join(
        [f"{weights.get(kind, 0.0)!r}D", *[f"case x.votes[{j}] when 1 then {weights.get(f'{kind} {name}+', 0.0)!r}D when -1 then {weights.get(f'{kind} {name}-', 0.0)!r}D else 0D end" for j, name in enumerate(VOTES)]]
    )
    return "case x.kind " + " ".join(f"when '{k}' then {of(k)}" for k in KINDS) + " end"


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (s, k, e, kind), in order, for each row."""
    stage = Staging(docs.sparkSession, "pii")
    found = stage.put(_candidates(docs, id_col, text_col), "candidates")
    told = lambda of, passed: F.transform(of, lambda x: F.struct(x["kind"].alias("kind"), F.lit(passed).alias("passed"), x["votes"].alias("votes")))
    votes = found.select(F.explode(F.concat(told("base", True), told("more", True), told("lost", False))).alias("x")).groupBy("x.kind", "x.passed", "x.votes").count()
    counts = sorted((r["kind"], r["passed"], list(r["votes"]), r["count"]) for r in votes.collect())  # at most 8 * 3**5 rows
    weights = train(counts, estimate(counts))
    bare = "x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind)"
    return found.select(
        "doc_id",
        F.expr(f"array_sort(transform(base, {bare}))").alias("base"),
        F.expr(f"array_sort(transform(concat(base, filter(more, x -> {_score(weights)} >= 0)), {bare}))").alias("spans"),
    )


def listed(spans: str) -> Column:
    """kind:start:end of a column of spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, x -> x.kind = '{kind}')) as bigint)")
