"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from base patterns (email, ip, card, phone) and wider ones (local phone numbers, identity numbers,
keys, bank accounts, street addresses).  Three labelers vote on each candidate with 1, 0 or -1 (abstain): a strict format, a gazetteer, and the words before
the span.  Expectation-maximisation over the counts of vote patterns, which are few whatever the corpus, estimates how
reliable each labeler is; its posteriors train the final span classifier, a logistic model on votes, kind and length.
Spans that the classifier accepts are added; base spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered_columns

# The base patterns (possessive forms of the stated ones, which match the same text without backtracking).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Wider candidates.
EXTRA = ("localphone", "natid", "key", "iban", "address")
LOCAL_PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
NAT_ID = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
HEX = r"[0-9a-f]{32,64}|[0-9A-F]{32,64}"
# What access keys of common services begin with, and how long they are.
ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36}|sk_(?:live|test)_[0-9A-Za-z]{16,64}|xox[abprs]-[0-9A-Za-z-]{10,72}|AIza[0-9A-Za-z_-]{35}"
KEY = rf"(?=[A-Za-z_-]*[0-9])(?:{HEX}|{ISSUED})"
# Length of a bank account number by country.
ACCOUNTS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
IBAN = "|".join(rf"(?:{'|'.join(c for c, m in ACCOUNTS.items() if m == n)})[0-9]{{2}}(?:\x20?[0-9A-Z]){{{n - 4}}}" for n in sorted(set(ACCOUNTS.values())))
#: Words for streets that mean nothing else, in the languages of the corpus; of the other ones the gazetteer says nothing.
STREETS = r"Street|Avenue|Road|Lane|Boulevard|Highway|Parkway|straße|strasse|gasse|allee|rue|boulevard|chemin|impasse|Calle|Avenida|Paseo"
NUMBER_FIRST = "|".join((
    r"[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}+\x20){1,3}(?:Street|Avenue|Road|Lane|Boulevard|Highway|Parkway|St|Ave|Rd|Ln|Drive|Dr|Blvd|Court|Ct|Square|Terrace)",
    r"[0-9]{1,4}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard|place|chemin|impasse|quai)\x20(?:(?:de|du|des|la|le|les)\x20|[ld]['’]){0,3}\p{Lu}[\p{L}-]+",
))
NAME_FIRST = "|".join((
    r"(?=\p{L}+\x20[0-9])\p{Lu}\p{Ll}{2,30}(?:straße|strasse|gasse|allee|weg|platz)\x20[0-9]{1,4}[a-z]?",
    r"(?:Calle|Avenida|Plaza|Paseo|Camino)\x20(?:(?:de|del|la|las|los|el)\x20){0,3}\p{Lu}\p{L}+,?\x20[0-9]{1,4}",
))
ADDRESS = f"{NUMBER_FIRST}|{NAME_FIRST}"
# told apart by the first character, so that a word of prose fails at once; each kind has a digit
WIDER = (
    rf"(?<![\p{{L}}\p{{N}}+.(-])(?:(?=[0-9(])(?:{LOCAL_PHONE}|{NAT_ID}|{KEY}|{NUMBER_FIRST})"
    rf"|(?=\p{{Lu}})(?:(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})|{KEY}|{NAME_FIRST})|(?=[a-gsx]){KEY})(?![\p{{L}}\p{{N}}-])"
)
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: The gazetteers and the context words, in the languages of the corpus.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|io|ai|co|me|tv|eu|at|be|bg|ch|cy|cz|de|dk|ee|es|fi|fr|gr|hr|hu|ie|is|it|li|lt|lu|lv|mt|nl|no|pl|pt|ro|se|si|sk|tr|uk|us|ca|mx|br|ar|cl|au|nz|jp|cn|in|kr|za|ru|ua)$"
COUNTRY = r"^\+(?:1|33|34|44|49|39|31|41|43|52|54)(?![0-9]{9}[0-9])"
ISSUERS = r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"
WORDS = r"(?i)\b(?:e-?mails?|mail|courriel|correo|phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|card|carte|karte|tarjeta|ip|host|server|ssn|token|key|secret|password|passwd|clave|contact|kontakt|iban|konto|account|compte|cuenta|address|adresse|anschrift|direcci[óo]n|lives|wohnt|habite|vive)\b"
NOT_WORDS = r"(?i)\b(?:version|figure|isbn|issn|page|chapter|commit|sha256|md5|checksum)\b"
CONTEXT = 32  # characters before a span
BLOCK = 128
#: Characters of a piece of a long text, and pieces of a larger one: cutting a span reads one piece, not the text up to it.
PIECE, PIECES = 1 << 10, 1 << 6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a column that a lambda uses would be computed anew for each of its elements."""
    return F.get(F.transform(F.array(value), body), 0)


def _before_each(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array the fold of all before it.  Done in three levels of blocks, so that the work per element is
    some BLOCK steps and one step for BLOCK * BLOCK elements, whatever the length."""
    total = lambda a: F.aggregate(a, zero, fold)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(a, b * BLOCK + 1, BLOCK)))

    def at(v: Column, inner: Column, outer: Column, i: Column) -> Column:
        j, k = F.floor(i / BLOCK).cast("int"), F.floor(i / (BLOCK * BLOCK)).cast("int")
        return fold(fold(total(F.slice(outer, 1, k)), total(F.slice(inner, k * BLOCK + 1, j - k * BLOCK))), total(F.slice(v, j * BLOCK + 1, i % BLOCK)))

    return _let(values, lambda v: _let(blocks(v), lambda inner: _let(blocks(inner), lambda outer: F.transform(v, lambda _, i: at(v, inner, outer, i)))))


def _prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an array."""
    return _before_each(lengths, lambda a, b: a + b, F.lit(0).cast("long"))


def _with_matches(df: DataFrame, text: str, out: str, pattern: str, guard: Column) -> DataFrame:
    """Adds array<struct<s, e, m, b>>: the leftmost non-overlapping matches with code-point bounds, and the end of what stands
    before each (up to CONTEXT characters, back to the match before the previous one).

    The text between matches and the matches themselves alternate, so bounds are prefix sums of their lengths.
    """
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string,b:string>>)")
    strings = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(strings))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(strings))
    df = df.withColumn("_n", F.transform("_m", lambda m, i: (F.length(m) + F.length(F.get(F.col("_p"), i))).cast("long")))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, _prefix_sums(F.col("_n"))))
    tail = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(CONTEXT))
    before = lambda i: tail(F.concat(tail(F.get(F.col("_p"), i - 1)), tail(F.get(F.col("_m"), i - 1)), tail(F.get(F.col("_p"), i))))
    value = F.transform("_m", lambda m, i: F.struct((F.get(F.col("_b"), i) + F.length(F.get(F.col("_p"), i))).alias("s"), (F.get(F.col("_b"), i) + F.get(F.col("_n"), i)).alias("e"), m.alias("m"), before(i).alias("b")))
    return df.withColumn(out, F.when(F.size("_m") > 0, value).otherwise(empty)).drop("_m", "_p", "_n", "_b")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Doubles every second digit from the right; of the sum, the last digit must be 0."""
    d = F.reverse(_digits(m))
    value = lambda i: F.substring(d, i + 1, 1).cast("int") if isinstance(i, int) else d.substr(i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _email, _ip, _card, _phone: arrays of (s, e, m)."""
    t = F.col(text)
    df = _with_matches(docs, text, "_email", EMAIL, t.contains("@"))
    df = _with_matches(df, text, "_ip", IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]"))
    df = _with_matches(df, text, "_card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    df = _with_matches(df, text, "_phone", PHONE, t.contains("+"))
    n = lambda x: F.length(_digits(x["m"]))
    df = df.withColumn("_ip", F.filter("_ip", lambda x: x["m"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")))
    df = df.withColumn("_card", F.filter("_card", lambda x: n(x).between(16, 19)))
    df = df.withColumn("_card", F.filter("_card", lambda x: _luhn(x["m"])))
    return df.withColumn("_phone", F.filter("_phone", lambda x: n(x).between(8, 15)))


def _kind(m: Column) -> Column:
    """Which of the wider kinds a match is of."""
    return F.when(m.rlike(rf"^{NAT_ID}$"), "natid").when(m.rlike(rf"^(?:{KEY})$"), "key").when(m.rlike(rf"^(?:{IBAN})$"), "iban").when(m.rlike(rf"^(?:{LOCAL_PHONE})$"), "localphone").otherwise("address")


def _account(m: Column) -> Column:
    """The checksum of a bank account number: its first four characters put last and letters read as 10 to 35, it is 1 modulo 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))
    code = lambda i: F.ascii(turned.substr(i, F.lit(1)))
    step = lambda a, i: F.when(code(i) >= 65, a * 100 + code(i) - 55).otherwise(a * 10 + code(i) - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _voted(kind: str | None, x: Column) -> Column:
    """A candidate with its kind, three votes, and a length bucket."""
    m, s = x["m"], x["s"]
    name = F.lit(kind) if kind else _kind(m)
    before = F.lower(x["b"])
    vote = lambda c: c.cast("int")
    strict = {"email": vote(F.length(m) <= 254), "ip": vote(~m.rlike(r"(?:^|\.)0[0-9]")), "card": vote(m.rlike(r"^(?:[0-9]{16,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})$")), "phone": vote(m.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]"))}
    listed = {"email": vote(m.rlike(DOMAINS)), "ip": vote(~m.rlike(r"^(?:0|10|127|255|192\.168)\.")), "card": vote(m.rlike(ISSUERS)), "phone": vote(m.rlike(COUNTRY))}
    of = lambda k: name == k
    issued = m.rlike(rf"^(?:{ISSUED})$")
    wide_strict = (
        F.when(of("key"), vote(issued | m.rlike("[A-Fa-f]") & m.rlike("[0-9]"))).when(of("natid"), 1).when(of("iban"), vote(m.rlike(r"^\S+$|^\S{4}(?:\x20\S{4})+(?:\x20\S{1,3})?$")))
        .when(of("address"), vote(m.rlike(r"(?<![0-9])[1-9][0-9]{0,3}(?![0-9])"))).otherwise(vote(m.rlike(r"^\([0-9]{3}\) |^[0-9]{3}([.-])[0-9]{3}\1")))
    )
    wide_listed = (
        F.when(of("natid"), vote(~m.rlike("^(?:000|666|9)"))).when(of("key"), F.when(issued | F.length(m).isin(32, 40, 64), 1).otherwise(-1)).when(of("iban"), 1)
        .when(of("address"), F.when(m.rlike(rf"(?:{STREETS})(?!\p{{L}})"), 1).otherwise(-1)).otherwise(vote(~m.rlike(r"^\(?[01]")))
    )
    context = F.when(before.rlike(WORDS), 1).when(before.rlike(NOT_WORDS), 0).otherwise(-1)
    return F.struct(s.alias("s"), x["e"].alias("e"), name.alias("kind"), (strict[kind] if kind else wide_strict).alias("v1"), (listed[kind] if kind else wide_listed).alias("v2"), context.alias("v3"), F.least(F.floor((x["e"] - s) / 8), F.lit(8)).cast("int").alias("len"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds, beside the base arrays, _cand (base candidates with votes) and _wide (other ones, not overlapping base spans)."""
    t = F.col(text)
    df = base_spans(docs, text)
    df = _with_matches(df, text, "_wide", WIDER, t.rlike("[0-9]"))
    df = df.withColumn("_wide", F.filter("_wide", lambda x: (_kind(x["m"]) != "iban") | _account(x["m"])))
    both = F.concat("_email", "_ip", "_card", "_phone")
    df = df.withColumn("_wide", F.filter("_wide", lambda w: ~F.exists(both, lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"]))))
    df = df.withColumn("_cand", F.concat(*[F.transform(f"_{k}", partial(_voted, k)) for k in BASE]))
    return df.withColumn("_wide", F.transform("_wide", partial(_voted, None)))


Pattern = tuple[str, int, int, int, int]


def label_model(counts: dict[tuple[str, int, int, int], float], rounds: int = 50) -> dict[tuple[str, int, int, int], float]:
    """Posteriors of "personal" by vote pattern: a two-class latent model with independent labelers, by EM.

    Each labeler has two accuracies, of its 1 and of its 0 votes, shared by kinds and held between a half and 0.99: a
    labeler is taken to be no worse than chance.  Abstaining says nothing.  Each kind has a prior.  Counts are over all
    candidates of the corpus; there are at most 27 patterns a kind.
    """
    prior = {k[0]: 0.6 for k in counts}
    accuracy = [[0.8, 0.7] for _ in range(3)]
    post: dict[tuple[str, int, int, int], float] = {}
    for _ in range(rounds):
        for p in counts:
            a, b = prior[p[0]], 1 - prior[p[0]]
            for (yes, no), vote in zip(accuracy, p[1:], strict=True):
                if vote >= 0:
                    a *= yes if vote else 1 - yes
                    b *= 1 - no if vote else no
            post[p] = a / (a + b)
        for kind in prior:
            n = sum(c for p, c in counts.items() if p[0] == kind)
            prior[kind] = (sum(c * post[p] for p, c in counts.items() if p[0] == kind) + 3) / (n + 5)
        for j in range(3):
            voted = [(p[j + 1], c, post[p]) for p, c in counts.items() if p[j + 1] >= 0]
            yes = (sum(c * q for v, c, q in voted if v) + 8) / (sum(c * q for _, c, q in voted) + 10)
            no = (sum(c * (1 - q) for v, c, q in voted if not v) + 7) / (sum(c * (1 - q) for _, c, q in voted) + 10)
            accuracy[j] = [min(0.99, max(0.5, x)) for x in (yes, no)]
    return post


def _features(p: Pattern) -> list[str]:
    return [f"kind={p[0]}", f"v1={p[1]}", f"v2={p[2]}", f"v3={p[3]}", f"len={p[4]}"]


def train(counts: dict[Pattern, float], rounds: int = 300) -> dict[str, float]:
    """A logistic model on indicator features, fitted to the label model's posteriors; at most 27 * 9 patterns a kind."""
    votes: dict[tuple[str, int, int, int], float] = {}
    for p, c in counts.items():
        votes[p[:4]] = votes.get(p[:4], 0.0) + c
    post = label_model(votes) if votes else {}
    weights: dict[str, float] = {"bias": 0.0}
    total = sum(counts.values()) or 1.0
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for p, c in counts.items():
            names = ["bias", *_features(p)]
            error = c / total * (post[p[:4]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in names))))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * 0.9999 + 2.0 * g
    return weights


def fit(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Counts candidates of the whole corpus by pattern and trains the span classifier on them."""
    spans = candidates(docs.select(text), text).select(F.explode(F.concat("_cand", "_wide")).alias("c"))
    rows = spans.groupBy("c.kind", "c.v1", "c.v2", "c.v3", "c.len").count().collect()  # bounded: kinds * 27 * 9 patterns
    return train({(r["kind"], r["v1"], r["v2"], r["v3"], r["len"]): float(r["count"]) for r in sorted(rows)})


def _accepted(x: Column, weights: dict[str, float]) -> Column:
    score = F.lit(weights.get("bias", 0.0))
    for name in ("kind", "v1", "v2", "v3", "len"):
        known = {f.split("=", 1)[1]: w for f, w in weights.items() if f.startswith(f"{name}=")}
        if known:
            part = None
            for value, w in sorted(known.items()):
                cond = x[name] == (value if name == "kind" else int(value))
                part = F.when(cond, w) if part is None else part.when(cond, w)
            score = score + part.otherwise(0.0)
    return score >= 0  # a probability of one half


def find(docs: DataFrame, text: str = "text", model: dict[str, float] | None = None) -> DataFrame:
    """Adds _spans, array<struct<s, e, kind>>: base spans and accepted others, by kind as listed, then by start."""
    weights = fit(docs, text) if model is None else model
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    df = candidates(docs, text)
    df = df.withColumn("_base", plain(F.col("_cand"))).withColumn("_more", plain(F.filter("_wide", lambda x: _accepted(x, weights))))
    of = lambda kind: F.filter("_more", lambda x: x["kind"] == kind)
    more = F.concat(*[of(k) for k in EXTRA])
    return df.withColumn("_spans", F.concat(F.col("_base"), more)).drop("_cand", "_wide", "_more")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.  A text without any has counts 0."""
    df = find(documents(docs))
    return df.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, cut in two steps, as finding a character reads the text up to it."""
    cut = lambda t, size: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / size).cast("int")), lambda i: t.substr(i * size + 1, F.lit(size)))
    return F.flatten(F.transform(cut(text, PIECE * PIECES), lambda big: cut(big, PIECE)))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0))), "")
    return near.substr((start - first * PIECE + 1).cast("int"), (end - start).cast("int"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, whatever their names, with each span's text replaced by its kind in brackets; overlapping spans
    become one, named by the first.

    n_chars, where there is such a column, is brought up to date.  Null texts stay null; an empty table stays empty.
    """
    rows, at = numbered_columns(docs)
    own = at[text]
    df = find(rows.withColumn("_t", F.coalesce(F.col(own), F.lit(""))), "_t")
    df = df.withColumn("_sorted", F.when(F.size("_spans") > 0, F.array_sort("_spans")))
    # a span begins a new run where no span before it reaches over its start; the run ends where the furthest of its spans does
    df = df.withColumn("_reach", _before_each(F.transform("_sorted", lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long")))
    df = df.withColumn("_first", F.filter(F.transform("_sorted", lambda x, i: F.when(x["s"] >= F.get(F.col("_reach"), i), i)), lambda i: i.isNotNull()))
    ends = lambda k: F.coalesce(F.get(F.col("_reach"), F.get(F.col("_first"), k + 1)), F.array_max(F.transform("_sorted", lambda x: x["e"])))
    df = df.withColumn("_runs", F.transform("_first", lambda i, k: F.struct(F.get(F.col("_sorted"), i)["s"].alias("s"), ends(k).alias("e"), F.get(F.col("_sorted"), i)["kind"].alias("kind"))))
    df = df.withColumn("_pieces", F.when(F.col("_runs").isNotNull(), _pieces(F.col("_t"))))
    before = lambda k: F.coalesce(F.get(F.col("_runs"), k - 1)["e"], F.lit(0).cast("long"))
    parts = F.transform("_runs", lambda x, k: F.concat(_cut(F.col("_pieces"), before(k), x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = _cut(F.col("_pieces"), F.element_at("_runs", -1)["e"], F.length("_t").cast("long"))
    df = df.withColumn("_new", F.when(F.col("_runs").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(own)))
    chars = at.get("n_chars")
    return df.select(*[F.col("_new").alias(c) if c == own else F.length("_new").cast(rows.schema[c].dataType).alias(c) if c == chars else F.col(c) for c in rows.columns]).toDF(*docs.columns)
