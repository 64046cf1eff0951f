"""Operator 13, personal data: generators propose spans, boosted trees weigh them, calibrated thresholds choose; SQL functions only.

Generators are patterns. Those of the base kinds are precise (`BASE`, fixed by the contract, with their checks) and their spans always
stay. The others (`LOOSE`) are made for recall: addresses spelt with at and dot, IPv6 groups, card numbers with other
separators, phone numbers without a plus sign. They may overlap each other and the base spans, and most of what they propose is no personal data.
A candidate's features are of its form (digits, groups, separators, Luhn, hexadecimal letters, lengths) and of its
context (words within `NEAR` characters on either side, as far as the generator's next candidate). Gradient boosting of `ROUNDS` trees of depth
`DEPTH` on the logistic loss gives a probability, as one column expression; for each generator a threshold is set on findings
held out of training, the least one that leaves `PRECISION` of what it lets through right. A generator that never gets there proposes nothing.

`labelled` are findings (generator, before, value, after, label), of which at most `MAX_FINDINGS` are used, those of the least hashes; by default they are made from a
seed, in SQL (`findings`). They are fitted on the driver, which is bounded by that number; documents never are. All work on documents is a map:
nothing is shuffled, a text is read where it lies, and work is linear in it but for the sorting of its spans. Patterns have no nested or
overlapping repeats and start only where a run of their characters starts, so no text makes them scan a run again and again.

Defined results: null and empty texts have no spans; repeated rows repeat their results; equal spans of one kind from several generators count once;
an empty table gives no rows; further columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_FINDINGS = 20_000
FINDINGS, SEED = 12_000, 17
NEAR = 40
ROUNDS, DEPTH, RATE, LEAF, PENALTY = 40, 3, 0.3, 20, 1.0
PRECISION = 0.99
# Matches whose places are summed in one go; beyond it places are summed block by block.
BLOCK = 256

# The base patterns of the contract, with possessive repeats, each begun at the first of its run or where the last match ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
LOOSE = {
    "spelt_email": ("email", rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++){{1,4}}+"),
    "ipv6": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:|::)(?:[0-9A-Fa-f]{0,4}+:){1,6}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])"),
    "spaced_card": ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:(?:[._/ ]|[\x20-]{1,3}+)?[0-9]){12,18}+(?![0-9])"),
    "plain_phone": ("phone", r"(?<![0-9A-Za-z+.,/_(-])(?<![0-9]\x20)(?<!\+[0-9]{1,3}[\x20.-]{1,2})(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}+[0-9]{2,5}){1,4}+(?![0-9A-Za-z_/-]|[.,][0-9])"),
}
# What every match of a pattern holds, cheaper to look for: texts without it are not scanned by the pattern.
CORE = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "spelt_email": r"[\[({\x20](?:at|AT|@)[\x20\])}]", "ipv6": ":[0-9A-Fa-f]{0,4}:",
    "spaced_card": r"[0-9](?:(?:[._/ ]|[\x20-]{1,3}+)?[0-9]){12}", "plain_phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{2}",
}
PHONE_WORDS = r"(?i)(?:tel|telefono|teléfono|telefon|téléphone|phone|fon|mobile|mobil|móvil|cell|call|ring|fax|whatsapp|appelez|llame|anrufen|handy)\b[^\pL]*$"
MAIL_WORDS = r"(?i)(?:e-?mail|mail|contact|correo|courriel|kontakt|reach|write|escriba|écrire|schreiben)\b[^\pL]*(?:\pL+[^\pL]+){0,2}$"
HOST_WORDS = r"(?i)(?:ip|ipv6|host|server|address|addr|client|from|peer|gateway|inet6?)\b[^\pL]*$"
CARD_WORDS = r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment|cc)\b[^\pL]*(?:\pL+[^\pL]+){0,1}$"
OTHER_WORDS = r"(?i)(?:order|invoice|isbn|version|ver|v|date|on|id|no|nr|ref|serial|part|page|pages|room|score|sum|time|uuid|mac|commit|since|until|between|build|release|case|ticket|tracking|sku)\b[^\pL]*$"
_N = lambda c, what: F.char_length(F.regexp_replace(c, f"[^{what}]+", ""))
_luhn = lambda digits: F.call_function("luhn_check", digits)
_has = lambda c, what: c.rlike(what).cast("int")


def luhn(value: Column) -> Column:
    return _luhn(F.regexp_replace(value, "[^0-9]+", ""))


def valid(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    n = _N(value, "0-9")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    if kind == "card":
        return (n >= 13) & (n <= 19) & luhn(value)
    return (n >= 9) & (n <= 15)


def places(lengths: Column) -> Column:
    """Sums of an array's items before each: in blocks, so that the work is not the square of a long array's length."""
    sums = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(BLOCK)))
    before = F.slice(sums(F.transform(blocks, total)), F.lit(1), F.size(blocks))
    long = F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(F.slice(sums(b), F.lit(1), F.size(b)), lambda x: x + at)))
    return F.when(F.size(lengths) <= BLOCK, F.slice(sums(lengths), F.lit(1), F.size(lengths))).otherwise(long)


def _spans(docs: DataFrame, text: str, name: str, pattern: str, core: str) -> DataFrame:
    """Adds an array, under the name, of the pattern's matches with their places and what stands beside them."""
    found, gaps, at = f"{name}_found", f"{name}_gaps", f"{name}_at"
    empty = F.array().cast("array<string>")
    out = docs.withColumn(found, F.when(F.col(text).rlike(core), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(empty))
    out = out.withColumn(at, places(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))))

    def span(m: Column, i: Column) -> Column:
        before, after = F.get(F.col(gaps), i), F.get(F.col(gaps), i + 1)
        start = F.get(F.col(at), i) + F.char_length(before)
        return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("value"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    return out.withColumn(name, F.transform(found, span)).drop(found, gaps, at)


def features(generator: Column, before: Column, value: Column, after: Column) -> dict[str, Column]:
    """What the trees weigh: numbers of a candidate's form and context, all of them integers."""
    first = F.regexp_extract(value, r"^\(?([0-9]+)", 1)
    return {
        **{f"is_{g}": (generator == g).cast("int") for g in LOOSE},
        "length": F.char_length(value), "digits": _N(value, "0-9"), "letters": _N(value, "A-Za-z"), "groups": F.size(F.split(value, r"[^0-9A-Za-z]+")), "blanks": _N(value, r"\x20"), "dots": _N(value, "."),
        "dashes": _N(value, r"\-"), "slashes": _N(value, "/"), "brackets": _N(value, r"()\[\]{}"), "colons": _N(value, ":"), "double_colon": _has(value, "::"), "luhn": F.coalesce(luhn(value), F.lit(False)).cast("int"),
        "first_group": F.char_length(first), "last_group": F.char_length(F.regexp_extract(value, "([0-9A-Za-z]+)$", 1)), "date": _has(value, r"(?:^|[^0-9])(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])(?:[-/. ]|$)|(?:^|[^0-9])[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](?:19|20)?[0-9]{2}$"),
        "years": _has(value, r"^\(?(?:1[5-9]|20)[0-9]{2}\)?[\x20/-]{1,2}(?:1[5-9]|20)[0-9]{2}$"), "same_separators": F.size(F.array_distinct(F.regexp_extract_all(value, F.lit(r"[\x20._/-]"), F.lit(0)))), "spelt_dot": _has(value, r"(?i)\bdot\b|[\[({]\.[\])}]"),
        "bracketed": _has(value, r"(?i)[\[({]\x20?(?:at|@)\x20?[\])}]"), "top_domain": _has(value, r"(?i)(?:\.|dot[\])}\x20]*)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|it|nl|ch|at)$"), "trunk": _has(value, r"^\(?0[0-9]"), "short_hex": _has(value, r"^(?:[0-9]{1,2}:)+[0-9]{1,2}$"),
        "mail_words": _has(before, MAIL_WORDS), "phone_words": _has(before, PHONE_WORDS), "host_words": _has(before, HOST_WORDS), "card_words": _has(before, CARD_WORDS), "other_words": _has(before, OTHER_WORDS),
        "sign_before": _has(before, r"[-$€£#=@%*\\/]\x20?$"), "number_before": _has(before, r"[0-9][,.;:\x20]*$"), "unit_after": _has(after, r"^\x20?(?:[%°€$£]|(?:kg|km|m|cm|mm|s|ms|h|am|pm|px|MB|GB|rows|points|pages)\b)"), "number_after": _has(after, r"^[,.;:\x20]*[0-9]"),
    }


def _pick(options: list[str], *salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64("id", *[F.lit(x) for x in salt]), F.lit(len(options))) + 1).cast("int"))


# Forms of made findings: # is a digit, 9 one from 1 to 9, h a hexadecimal digit, w a made word. True ones and look-alikes, with what leads up to them.
FORMS = {
    "spelt_email": (
        (["w at w dot com", "w.w at w dot org", "w## [at] w.com", "w(at)w.de", "w [at] w [dot] net", "w.w AT w DOT com", "w_w at w.org", "w {at} w.fr", "w.## [at] w## dot com"], ["email ", "", "write to ", "contact: ", "my mail is ", "w w w ", "courriel ", "kontakt: "]),
        (["w at w.W", "w at w.w", "w at 9.##", "w at w.An", "W at 9#.#", "w at w.9", "w at noon.W", "w-w at w.W"], ["", "w w ", "we were ", "the ", "w, ", "meet ", "contact w ", "on "]),
    ),
    "ipv6": (
        (["hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "fe80::hhhh:hhhh:hhhh:hhhh", "2001:db8::hhhh", "2001:0:hhhh:hhh::h", "hhhh:hh::hhhh:9", "::hhhh:hhhh"], ["ip ", "", "host ", "from ", "inet6 ", "w ", "peer "]),
        (["9#:##:##", "##:##:##", "9:##:9#", "hh:hh:hh:hh:hh:hh", "9::9", "a::b", "9#:9#:9", "##:##:##:##"], ["at ", "", "w ", "mac ", "time ", "on ", "from "]),
    ),
    "spaced_card": (
        (["L9###.####.####.###", "L9###_####_####_###", "L9###  ####  ####  ###", "L9### - #### - #### - ###", "L9###/####/####/###", "L9### ###### ####", "L9###.######.####"], ["card ", "", "visa: ", "w w ", "payment by ", "carte ", "tarjeta "]),
        (["N9#########.###", "N978.9.###.#####.#", "N9###.####.####.####", "N20##.0#.9#.9#.##.##", "N9#.###.###.###.###", "N9##/####/####/####", "N9###  9###  9###  9###", "L9##-9### 1##.9#.2##.9#", "L9###-#### 1##.1##.9#.2##", "L9#.9#.20## 9#.9##.9##", "L20##-0#-9# 9##.9##.9##"], ["order ", "", "isbn ", "w ", "ref ", "sum ", "tracking ", "serial "]),
    ),
    "plain_phone": (
        (["(9##) 555-9###", "(9##) 9##-####", "9##-9##-####", "9##.9##.####", "0## 9### ####", "0### 9#####", "00## 9## 9######"[:15], "0# ## ## ## ##", "(0##) 9######"[:12], "9## 9## ####", "0###/9####", "9## ## ## ##"], ["phone ", "", "tel: ", "call ", "fax ", "w w ", "mobile ", "téléphone ", "llame "]),
        (["20##-0#-9#", "19##/0#/##", "9#/0#/20##", "0#.0#.20##", "19##-20##", "9# ###", "9# ### ###", "9##.##", "99-9##-####-9", "9## 9##", "9#-9#", "9#.9#.9#", "9##-9#-9####", "9# ## ##", "978-9-##-####-9", "9###-9###", "9#####-##", "1##.9#.2##.1##", "9#.2##.9#.1##", "1##.1##.1##.9#", "2##.2##.1##.2##", "9##.1##.9##.9##"], ["on ", "", "w ", "order ", "version ", "pages ", "isbn ", "w w ", "no ", "between ", "score ", "$", "call ", "in "]),
    ),
}


def findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """Labelled findings (generator, before, value, after, label), made in SQL from a seed: a form and what leads to it, filled with hashed digits and words."""
    words = ["ther", "eina", "onel", "mira", "tolan", "besk", "quen", "rivo", "salet", "dorn", "ulme", "hask"]
    names = list(FORMS)
    rows = spark.range(0, n, 1, 4).withColumn("generator", _pick(names, f"g{seed}")).withColumn("label", F.pmod(F.xxhash64("id", F.lit(f"l{seed}")), F.lit(2)).cast("int"))
    value = lead = F.lit("")
    for g in names:
        for label in (1, 0):
            (forms, leads), here = FORMS[g][1 - label], (F.col("generator") == g) & (F.col("label") == label)
            value, lead = F.when(here, _pick(forms, f"f{seed}")).otherwise(value), F.when(here, _pick(leads, f"p{seed}")).otherwise(lead)

    def fill(form: Column, salt: str) -> Column:
        chars = F.split(form, "")
        random = lambda i: F.pmod(F.xxhash64("id", F.lit(f"{salt}{seed}"), i), F.lit(1 << 30))
        hexa = lambda i: F.substring(F.lit("0123456789abcdef"), (random(i) % 16 + 1).cast("int"), F.lit(1))
        word = lambda i: F.element_at(F.array(*[F.lit(w) for w in words]), (random(i) % len(words) + 1).cast("int"))
        one = lambda c, i: F.when(c == "#", (random(i) % 10).cast("string")).when(c == "9", (random(i) % 9 + 1).cast("string")).when(c == "h", hexa(i)).when(c == "w", word(i)).when(c == "W", F.initcap(word(i))).otherwise(c)
        return F.array_join(F.transform(chars, one), "")

    # w, h and 9 of fixed words are not to be filled: only forms of the list above hold them
    filled = rows.withColumn("form", value).withColumn("value", fill(F.regexp_replace("form", "^[LN]", ""), "v")).withColumn("before", F.concat(fill(F.lit("w w "), "b"), F.when(lead.rlike(r"^(?:w[ ,]*)+$"), fill(lead, "c")).otherwise(lead)))
    digits = F.regexp_replace("value", "[^0-9]+", "")
    check = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(digits, d.cast("string")))), True) - 1
    # L ends in the digit that makes the number pass, N in one that does not
    last = F.when(F.col("form").startswith("L"), check).when(F.col("form").startswith("N"), (check + 1 + F.pmod(F.xxhash64("id"), F.lit(9))) % 10)
    after = _pick([" w w", ".", ", w", "\n", " w", ""], f"a{seed}")
    return filled.select("generator", "before", F.concat("value", F.coalesce(last.cast("string"), F.lit(""))).alias("value"), fill(after, "d").alias("after"), "label")


class Boosted:
    """Trees on the logistic loss, as nested tuples (feature, cut, left, right) with numbers at their ends, and a threshold for each generator."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, generator: np.ndarray, hold: np.ndarray):
        if len(np.unique(y[~hold])) < 2:
            raise ValueError("labelled findings of both kinds are needed")
        self.names = names
        self.base = math.log(y[~hold].mean() / (1 - y[~hold].mean()))
        self.trees: list = []
        fx, fy = x[~hold], y[~hold]
        score = np.full(len(fy), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(fx, fy - p, p * (1 - p), 0)
            self.trees.append(tree)
            score += self._walk(tree, fx)
        held = self.probability(x)
        self.thresholds = {g: self._threshold(held[hold & (generator == g)], y[hold & (generator == g)]) for g in LOOSE}

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        here = RATE * g.sum() / (h.sum() + PENALTY)
        if depth == DEPTH:
            return float(here)
        best, whole = (1e-6, None, None), g.sum() ** 2 / (h.sum() + PENALTY)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1], method="lower")):
                left = x[:, f] <= cut
                n = left.sum()
                if min(n, len(left) - n) >= LEAF:
                    a, b = g[left].sum(), h[left].sum()
                    gain = a**2 / (b + PENALTY) + (g.sum() - a) ** 2 / (h.sum() - b + PENALTY) - whole
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is None:
            return float(here)
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], g[left], h[left], depth + 1), self._grow(x[~left], g[~left], h[~left], depth + 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._walk(tree[2], x), self._walk(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.base - sum(self._walk(t, x) for t in self.trees)))

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The least probability from which on PRECISION of the held-out findings are true; over 1 if there is none."""
        order = np.argsort(-p)
        right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        ends = np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
        good = np.flatnonzero((right >= PRECISION) & ends)
        return max(0.5, float(p[order][good[-1]])) if len(good) else 2.0

    def sql(self, of: str) -> str:
        """The probability as SQL, of the features that are fields of a struct."""
        walk = lambda t: f"{t!r}D" if isinstance(t, float) else f"CASE WHEN {of}.{self.names[t[0]]} <= {t[1]:.0f} THEN {walk(t[2])} ELSE {walk(t[3])} END"
        total = reduce(lambda a, t: f"{a} + {walk(t)}", self.trees, f"{self.base!r}D")
        return f"1 / (1 + exp(-({total})))"


_models: dict[tuple[str, int], Boosted] = {}


def train(spark: SparkSession, labelled: DataFrame | None = None) -> Boosted:
    """The trees of at most MAX_FINDINGS findings; a fifth of them, by hash, is held out for the thresholds. Those of the made findings are fitted once a session."""
    of = ["generator", "before", "value", "after", "label"]
    key = (spark.sparkContext.applicationId, SEED)
    if labelled is None and key in _models:
        return _models[key]
    some = (findings(spark) if labelled is None else labelled).select(*of).orderBy(F.xxhash64(*of), *of).limit(MAX_FINDINGS)
    measures = features(*[F.coalesce(F.col(c), F.lit("")) for c in of[:4]])
    got = some.select("generator", "label", (F.pmod(F.xxhash64("value", "before"), F.lit(5)) == 0).alias("hold"), *[c.alias(n) for n, c in measures.items()]).collect()
    x = np.array([[r[n] for n in measures] for r in got], float).reshape(len(got), len(measures))
    model = Boosted(list(measures), x, np.array([r.label for r in got], float), np.array([r.generator for r in got]), np.array([r.hold for r in got], bool))
    if labelled is None:
        _models[key] = model
    return model


def find(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Adds `base` and `spans`, arrays of (kind_no, start, end, generator, probability), to docs(text, ...), by kind, start and end; base spans have probability 1."""
    model = train(docs.sparkSession, labelled)
    taken = {c.lower() for c in docs.columns}
    text = next(n for n in (f"whole_text{'_' * i}" for i in range(len(taken) + 1)) if n not in taken)
    names = {g: next(n for n in (f"pd_{g}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for g in [*BASE, *LOOSE]}
    out = docs.drop("base", "spans").withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    for g, pattern in BASE.items():
        out = _spans(out, text, names[g], pattern, CORE[g])
    for g, (_, pattern) in LOOSE.items():
        out = _spans(out, text, names[g], pattern, CORE[g])

    for g in LOOSE:
        # features first, so that the trees name them and don't work them out at each branch
        measure = lambda x: F.struct(x.alias("of"), *[c.alias(n) for n, c in features(x["generator"], x["before"], x["value"], x["after"]).items()])
        out = out.withColumn(names[g], F.transform(F.transform(names[g], lambda x: x.withField("generator", F.lit(g))), measure))
        out = out.withColumn(names[g], F.expr(f"transform({names[g]}, x -> struct(x.of AS of, {model.sql('x')} AS p))"))

    def chosen(g: str, kind: str) -> Column:
        span = lambda x, p: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), x["start"].alias("start"), x["end"].alias("end"), F.lit(g).alias("generator"), p.alias("probability"))
        if g in BASE:
            return F.transform(F.filter(names[g], lambda x: valid(kind, x["value"])), lambda x: span(x, F.lit(1.0)))
        return F.transform(F.filter(names[g], lambda x: x["p"] >= model.thresholds[g]), lambda x: span(x["of"], x["p"]))

    base, more = [chosen(g, g) for g in KINDS], [chosen(g, kind) for g, (kind, _) in LOOSE.items()]
    same = lambda a, b: (a["kind_no"] == b["kind_no"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])
    out = out.withColumn("base", F.concat(*base)).withColumn("spans", F.concat("base", *more)).drop(text, *names.values())
    # base spans come first among equal ones, as their generators' names are the kinds'
    return out.withColumn("spans", F.array_sort("spans")).withColumn("spans", F.filter("spans", lambda x, i: (i == 0) | ~same(x, F.get(F.col("spans"), i - 1))))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of what `find` gives for docs(doc_id, text)."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs(text, ...) with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the kind of the first."""
    found = find(docs, labelled)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("text").cast("string")

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        fresh = F.concat(s["parts"], F.array(gap, F.concat(F.lit("["), F.get(kinds, x["kind_no"]), F.lit("]"))))
        inside = x["start"] < s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(inside, s["parts"]).otherwise(fresh).alias("parts"))

    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"))))
    whole = F.aggregate(by_start, begin, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    return found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(text)).drop("base", "spans").select(*docs.columns)
