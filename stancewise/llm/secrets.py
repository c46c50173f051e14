"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: The three base kinds, as pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: What the battery looks at.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
RANKS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
#: What counts as ordinary text: symbol counts whose chi-squared exceeds its mean by symbols / UNEVEN for each character, or runs or
#: serial correlation off by SHIFT standard errors times the root of the length. Words spell letters so unevenly that they exceed it
#: by symbols / 16 or more, mixed with digits by symbols / 25; limits closer to an even draw (50, 0.6) miss most keys under 40 characters.
UNEVEN, SHIFT = 35, 0.8
#: False-discovery level; bins of -ln p in which p-values are counted over the corpus.
LEVEL, BIN, BINS = 0.05, 0.1, 400
#: Matches whose places are added up at a time; characters of a string that are looked at at a time.
CHUNK, PIECE = 64, 4096


def _parts(text: Column, pattern: str, group: int) -> Column:
    """array<struct<gap, hit, size>> of the leftmost non-overlapping matches: the text before, the match, the length of its group."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(hits, F.length)
    parts = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sized.alias("size"))
    return F.when(text.rlike(pattern), parts).otherwise(F.expr("cast(array() as array<struct<gap:string,hit:string,size:int>>)"))


def _places(parts: Column) -> Column:
    """array<struct<start, end, hit, size>> of matches, in code points.

    The places are running sums of lengths: first of chunks of CHUNK matches, then inside each, so that a text of many matches
    costs their number times CHUNK and not its square.
    """
    width = lambda p: F.length(p["gap"]) + F.length(p["hit"])
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / CHUNK).cast("int") - 1, F.lit(0))), lambda i: F.slice(parts, i * CHUNK + 1, F.lit(CHUNK)))
    before = F.aggregate(
        F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + width(p))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,size:int>>)")
    step = lambda acc, p: F.struct(
        (acc["at"] + width(p)).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + width(p)).alias("end"), p["hit"].alias("hit"), p["size"].alias("size")))).alias("out"),
    )
    return F.flatten(F.zip_with(chunks, before, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))


def _masked(text: Column, parts: Column, least: int) -> Column:
    """text with line feeds in place of the matches of at least that size."""
    kept = F.transform(parts, lambda p: F.concat(p["gap"], F.when(p["size"] >= least, F.repeat(F.lit("\n"), F.length(p["hit"]))).otherwise(p["hit"])))
    used = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
    return F.when(F.size(parts) == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.substr(text, used + 1)))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal law (logistic approximation, error below 2e-4)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _battery(s: Column) -> Column:
    """struct<n, nlp>: length, and -ln of the p-value of the hypothesis that s is ordinary text and not drawn evenly from
    its inferred alphabet.

    Three tests, each of the hypothesis of a departure at least as large as UNEVEN and SHIFT say: chi-squared of the
    symbol counts (lower tail of the noncentral law), runs about the middle of the alphabet, and lag-1 serial correlation of
    the symbol numbers. The largest p-value counts, so only what passes all three is random. A short string cannot
    pass: the laws with and without departure part with the root of the length. Null where s has no digit or no letter.
    """
    body = F.rtrim(s, F.lit("="))
    kind = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    body = F.when(kind == "hex", F.lower(body)).otherwise(body)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), kind)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    base = F.struct(body.alias("s"), alphabet.alias("abc"), F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"))

    def sums(b: Column) -> Column:
        s, n, k = b["s"], b["n"], b["k"]
        squares = F.aggregate(chars(b["abc"]), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(s, c)).cast("double")), F.lit(2.0)))
        high = lambda x: x > k / 2
        step = lambda t, x: F.struct(
            x.alias("last"), F.when(t["last"] > 0, t["first"]).otherwise(x).alias("first"), (t["sum"] + x).alias("sum"), (t["own"] + x * x).alias("own"), (t["cross"] + t["last"] * x).alias("cross"),
            (t["above"] + high(x).cast("double")).alias("above"), (t["runs"] + ((t["last"] == 0) | (high(t["last"]) != high(x))).cast("double")).alias("runs"),
        )
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("last", "first", "sum", "own", "cross", "above", "runs")])
        pieces = F.regexp_extract_all(s, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
        total = F.aggregate(pieces, zero, lambda t, piece: F.aggregate(F.transform(chars(piece), lambda c: F.instr(b["abc"], c).cast("double")), t, step))
        return F.struct(n.alias("n"), k.alias("k"), (k / n * squares - n).alias("chi"), total.alias("t"))

    def tests(b: Column) -> Column:
        n, k, t = b["n"], b["k"], b["t"]
        extra = n * k / UNEVEN
        z_chi = (b["chi"] - (k - 1 + extra)) / F.sqrt(2 * (k - 1 + 2 * extra))
        mean, above = t["sum"] / n, t["above"]
        cross, own = t["cross"] - mean * (2 * t["sum"] - t["first"] - t["last"]) + (n - 1) * mean * mean, t["own"] - n * mean * mean
        runs_mean = 2 * above * (n - above) / n + 1
        runs_var = F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(1e-9))
        z_runs, z_serial = (t["runs"] - runs_mean) / F.sqrt(runs_var), F.when(own > 0, cross / F.greatest(own, F.lit(1e-9))).otherwise(1.0) * F.sqrt(n)
        far = SHIFT * F.sqrt(n)
        p = F.greatest(_tail(-z_chi), _tail(far - F.abs(z_runs)), _tail(far - F.abs(z_serial)), F.lit(1e-17))
        return F.struct(n.alias("n"), (-F.ln(p)).alias("nlp"))

    one = F.transform(F.transform(F.array(base), sums), tests)
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), one[0])


def _base(parts: Column, kind: str, least: int) -> Column:
    kept = F.filter(_places(parts), lambda p: p["size"] >= least)
    return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), F.lit(RANKS[kind]).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """One row per document: doc_id, base (array of kind, start, end) and spans (base and added), ordered by place.

    Base spans come from the three patterns. The battery then tests every other string of 20 or more key characters with
    digits and letters (outside assignments; a string that holds another base span is none). Its hypothesis is "ordinary
    text"; Benjamini-Hochberg over the whole corpus, weighted by length (a longer string tells more, so it gets the larger share
    of the level), decides which strings are random. Those are added as kind ``random``: the level bounds the share of ordinary
    strings among them. Only counts per length class and p-value bin (at most 16 x 400) reach the driver.

    Null text counts as empty; documents without secrets get empty arrays; repeated rows give repeated results; extra
    columns are ignored; an empty table gives an empty result. The work is linear in the length of a text and its matches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({kind: _parts(F.col("text"), pattern, group) for kind, (pattern, group, _) in KINDS.items()})
    base = [_base(F.col(kind), kind, least) for kind, (_, _, least) in KINDS.items()]
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), _masked(F.col("text"), F.col("assign"), KINDS["assign"][2]).alias("rest"))
    rows = rows.select("doc_id", "base", _parts(F.col("rest"), CANDIDATE, 0).alias("parts"))
    fit = lambda p: p["hit"].rlike("[0-9]") & ~p["hit"].rlike(f"{KINDS['hex'][0]}|{KINDS['access'][0]}")
    tested = F.transform(F.filter(_places(F.col("parts")), fit), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), _battery(p["hit"]).alias("test")))
    rows = rows.select("doc_id", "base", F.filter(tested, lambda t: t["test"].isNotNull()).alias("tested"))
    size_class = lambda n: F.least(F.floor(F.log2(n)), F.lit(15)).cast("int")
    rows = settle(rows.select("doc_id", "base", F.transform("tested", lambda t: F.struct(t["start"].alias("start"), F.lit(RANKS["random"]).alias("rank"), t["end"].alias("end"), F.lit("random").alias("kind"), size_class(t["test"]["n"]).alias("of"), t["test"]["nlp"].alias("nlp"))).alias("tested")))

    seen = rows.select(F.explode("tested").alias("t")).groupBy("t.of", F.least(F.floor(F.col("t.nlp") / BIN), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    limits = _limits([tuple(r) for r in seen.collect()], level)
    table = F.create_map(*[x for of, v in limits.items() for x in (F.lit(of), F.lit(v))]) if limits else None
    keep = (lambda t: t["nlp"] >= F.coalesce(F.try_element_at(table, t["of"]), F.lit(float("inf")))) if limits else (lambda t: F.lit(False))
    added = F.transform(F.filter("tested", keep), lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), t["kind"].alias("kind")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _limits(counts: list[tuple[int, int, int]], level: float) -> dict[int, float]:
    """Per length class, the -ln p from which weighted Benjamini-Hochberg rejects, from binned counts.

    Class weights are proportional to the class's exponent of two and average 1 over the candidates. A bin counts with
    its least significant edge, so the decision errs towards not rejecting.
    """
    import math

    total = sum(n for _, _, n in counts)
    if not total:
        return {}
    mean = sum(of * n for of, _, n in counts) / total
    weight = {of: of / mean for of, _, _ in counts}
    scored = sorted(((b * BIN + math.log(weight[of]), n) for of, b, n in counts), reverse=True)
    cut, seen = math.inf, 0
    for nlp, n in scored:
        seen += n
        if math.exp(-max(nlp, 0)) <= level * seen / total:
            cut = nlp
    return {of: (cut - math.log(w)) for of, w in weight.items()}


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
