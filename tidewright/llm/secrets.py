"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The two first-order models are counted from labelled samples on the driver; the log-likelihood ratio of a run of
identifier characters is the sum of a table's entries for its neighbouring characters. A run that isn't random as a whole
is searched for random stretches by a running sum, so that a string joined to ordinary words is found; a stretch is
widened to the nearest of / _ - = or the run's ends. All work on texts is DataFrame expressions.

Defined results: a null text has no spans, and is passed on as null by redacted(). Positions are code points, end
exclusive. Random-string spans stand beside the patterns' spans, also where both cover the same characters: the models'
judgement doesn't depend on the patterns. Rows and other columns pass through. Work on a text grows with its length.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy and can't overlap, so the least lengths of these two may stand in the patterns.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12
RUN = r"[A-Za-z0-9+/=_-]{16,}"
#: Natural-log ratio from which a run counts as random, in total and for each character.
RATIO, RATIO_EACH = 10.0, 0.75
#: Least characters of a random stretch inside a run, and the fall of the running sum that ends it.
LEAST_STRETCH, FALL = 12, 8.0
MASK = "[SECRET]"
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"

#: The labelled sample of ordinary identifiers and words.
ORDINARY = """
configuration_manager get_current_user_name is_valid_request handleResponseError createConnectionPool parseDocumentHeader
MAX_RETRY_COUNT DEFAULT_TIMEOUT_SECONDS content-type-header internationalization responsibilities misunderstanding
application/json text/html/charset src/main/resources/templates usr/local/share/documentation lib/python/site-packages
readme-first-before-installing background-color-transparent margin-bottom-large user_profile_settings_page
2021-03-04 2019/11/30 1234567890123456 20240131 4111-1111-1111-1111 0044-20-7946-0018 192-168-001-254 9783161484100
wonderful-experience the_quick_brown_fox_jumps_over_the_lazy_dog whatever-happens-then nevertheless_and_therefore
anticonstitutionnellement developpement-personnel gouvernement fonctionnement quelquefois vraisemblablement maintenant
Geschwindigkeitsbegrenzung Verantwortlichkeit Wissenschaftlerin Zusammenarbeit Aufmerksamkeit Entschuldigung Donnerstag
responsabilidades internacionalizacion desafortunadamente administraciones conocimientos caracteristicas independiente
theandinghereonations atentionerreshand enteringstationthere ofthewhichother berungenichtscheinverlich
queelleiaierelletionlamentle menteadosciasesrrbo schlichkeitgebeverunder ----------------- ================ ________________
testConnectionWithInvalidCredentials UpdateCustomerAddress onButtonClicked print_formatted_message sort_by_last_modified
""".split()  # fmt: skip


def random_strings(n: int = 400, seed: int = 7) -> list[str]:
    """The labelled sample of random strings, by rule: hexadecimal, upper case with digits, mixed, and base-64 ones."""
    alphabets = ["0123456789abcdef", CHARACTERS[26:62], CHARACTERS[:62], CHARACTERS[:64]]
    state, out = seed, []
    for k in range(n):
        alphabet = alphabets[k % len(alphabets)]
        word = ""
        for _ in range(20 + k % 21):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            word += alphabet[(state >> 33) % len(alphabet)]
        out.append(word)
    return out


def model(strings: list[str], weight: float = 4.0) -> list[list[float]]:
    """Natural logs of the probability of each character after each: counts, and `weight` times the share of the character
    anywhere, add-half smoothed."""
    size = len(CHARACTERS)
    counts, single = [[0.0] * size for _ in range(size)], [0.5] * size
    for s in strings:
        known = [CHARACTERS.index(c) for c in s if c in CHARACTERS]
        for c in known:
            single[c] += 1
        for a, b in zip(known, known[1:], strict=False):
            counts[a][b] += 1
    share = [x / sum(single) for x in single]
    return [[math.log((x + weight * p) / (sum(row) + weight)) for x, p in zip(row, share, strict=True)] for row in counts]


def ratios(random: list[str], ordinary: list[str]) -> list[float]:
    """The log-likelihood ratio of each pair of neighbours, in one row; ordinary ones count in upper case as well."""
    p, q = model(random), model([*ordinary, *(s.upper() for s in ordinary)])
    return [x - y for a, b in zip(p, q, strict=True) for x, y in zip(a, b, strict=True)]


def _pair_ratios(run: Column, weights: list[float]) -> Column:
    size = len(CHARACTERS)
    lookup = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one constant, not one for each weight
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(CHARACTERS), c) - 1)
    return F.zip_with(F.slice(codes, 1, F.length(run) - 1), F.slice(codes, 2, F.length(run)), lambda a, b: F.get(lookup, a * size + b))


def log_ratio(run: Column, weights: list[float]) -> Column:
    return F.aggregate(_pair_ratios(run, weights), F.lit(0.0), lambda s, x: s + x)


_PARTS = "array<struct<low:int,high:int>>"


def stretches(run: Column, weights: list[float]) -> Column:
    """low, high of the random stretches of a run: each where the sum of its ratios less RATIO_EACH goes from nothing to a
    peak, before it falls by FALL or to nothing."""
    none = F.array().cast(_PARTS)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("low"), F.lit(0).alias("high"), none.alias("out"))

    def closed(s):
        long = s["high"] - s["low"]
        good = (long >= LEAST_STRETCH) & (s["peak"] + RATIO_EACH * (long - 1) >= RATIO)
        return F.when(good, F.concat(s["out"], F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"))))).otherwise(s["out"])

    def step(s, x):
        new = s["sum"] + x - RATIO_EACH
        idle, over, up = s["sum"] <= 0, (new <= 0) | (s["peak"] - new > FALL), new > s["peak"]
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(over, 0.0).otherwise(new).alias("sum"), F.when(over, 0.0).when(up, new).otherwise(s["peak"]).alias("peak"),
            F.when(idle, s["at"]).otherwise(s["low"]).alias("low"), F.when(over, 0).when(up, s["at"] + 2).otherwise(s["high"]).alias("high"), F.when(over, closed(s)).otherwise(s["out"]).alias("out"),
        )

    def widened(x):
        head, tail = F.substring(run, F.lit(1), x["low"]), F.substring(run, x["high"] + 1, F.length(run))
        low = F.when(F.substring(run, x["low"] + 1, F.lit(1)).rlike("[/_=-]"), x["low"] + 1).otherwise(x["low"] - F.length(F.regexp_extract(head, "[A-Za-z0-9+]*$", 0)))
        high = F.when(F.substring(run, x["high"], F.lit(1)).rlike("[/_=-]"), x["high"] - 1).otherwise(x["high"] + F.length(F.regexp_extract(tail, "^[A-Za-z0-9+]*", 0)))
        return F.struct(low.alias("low"), high.alias("high"))

    return F.array_distinct(F.transform(F.aggregate(_pair_ratios(run, weights), zero, step, closed), widened))


#: Elements that a running sum handles at once; its copies grow with the product of this and the number of elements.
SCANNED = 128


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once though body names it often or inside a function of elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column, joined) -> Column:
    """start, joined with the elements of an integer array one after the other: as many results as elements, each without
    its own element; in blocks, so that long arrays aren't copied for each element."""
    all_of = lambda of, whole: F.aggregate(of, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct(joined(s["at"], whole(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def summed(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SCANNED).cast("int")), lambda b: F.slice(v, b * SCANNED + 1, SCANNED))
        return _bound(blocks, lambda parts: F.flatten(F.zip_with(parts, all_of(parts, lambda part: F.aggregate(part, start, joined)), lambda part, at: F.transform(all_of(part, lambda x: x), lambda x: joined(at, x)))))

    return _bound(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """start, kind, end of the parts of matches that keep(matches) names; from what lies between the matches."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("run")))

    def placed(pair):
        steps, parts = pair["steps"], pair["parts"]
        starts = F.zip_with(_running(F.transform(steps, lambda x: x["gap"] + x["run"]), F.lit(0), lambda a, x: a + x), steps, lambda at, x: at + x["gap"])
        row = lambda start, p: F.struct((start + p["low"]).alias("start"), F.lit(kind).alias("kind"), (start + p["high"]).alias("end"))
        return F.flatten(F.zip_with(starts, parts, lambda start, own: F.transform(own, lambda p: row(start, p))))

    made = _bound(F.struct(sizes.alias("steps"), F.transform(keep(found), lambda m: m["parts"]).alias("parts")), placed)
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def found(docs: DataFrame, into: str, text: str = "text", random: list[str] | None = None, ordinary: list[str] | None = None) -> DataFrame:
    """docs with an array column named into of start, kind (a position in KINDS) and end, by start and then kind."""
    weights = ratios(random or random_strings(), ordinary or ORDINARY)
    t = F.coalesce(F.col(text), F.lit(""))
    all_of = lambda r: F.array(F.struct(F.lit(0).alias("low"), F.length(r).alias("high")))
    everything = lambda runs: F.transform(runs, lambda r: F.struct(r.alias("run"), all_of(r).alias("parts")))
    values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    long = lambda runs: F.zip_with(runs, values, lambda r, v: F.struct(r.alias("run"), F.when(F.length(v) >= LEAST_ASSIGN, all_of(r)).otherwise(F.array().cast(_PARTS)).alias("parts")))

    def odd(runs):
        def one(r):
            whole = log_ratio(r, weights) >= F.greatest(F.lit(RATIO), RATIO_EACH * F.length(r))
            return F.struct(r.alias("run"), F.when(whole, all_of(r)).otherwise(stretches(r, weights)).alias("parts"))

        return F.transform(runs, one)

    spans = F.concat(_spans(t, ASSIGN, 0, long), _spans(t, ACCESS, 1, everything), _spans(t, HEX, 2, everything), _spans(t, RUN, 3, odd))
    return docs.withColumn(into, F.array_sort(spans))


def redacted(docs: DataFrame, text: str = "text", mask: str = MASK, **how) -> DataFrame:
    """docs with each secret, or stretch of overlapping ones, in the text column replaced by the mask."""
    from .common import fresh

    at = fresh(docs, "spans")
    c = F.col(text)

    def masked(pair):
        # Four bytes a character, as a position in UTF-8 is found by counting from the start. The mark in front is dropped
        # when read, and so keeps one that the text itself begins with.
        spans, wide = pair["spans"], pair["wide"]
        reach = _running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        part = lambda low, high: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(wide, 4 * low + 1, 4 * (high - low))), "utf-32")
        pieces = F.zip_with(spans, reach, lambda x, r: F.when(x["start"] >= r, F.concat(part(r, x["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(spans, lambda x: x["end"])), F.octet_length(wide)))

    both = F.struct(F.col(at).alias("spans"), F.encode(c, "utf-32").alias("wide"))
    return found(docs, at, text, **how).withColumn(text, F.when(F.size(at) > 0, _bound(both, masked)).otherwise(c)).drop(at)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(list(KINDS)), s["kind"]), s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(F.encode(_joined(base), "utf-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
