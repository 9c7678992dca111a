"""User state: event folds, last-writer-wins records, sanitising of untrusted input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, STEP = 20, 2
LISTS = ["saved", "attending", "dismissed", "tracked"]


#: Events of one key that are folded in one row.  A key with more is folded in pieces, which are then put together.
CHUNK = 4096


def _pieces(events: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """keys, __piece (in order), __first (whether it is the key's first) and __events (at most CHUNK structs with ``v``, in order).

    Rows are dealt by range of key and order, so that a key of any size spreads over many tasks, and cut every CHUNK rows.
    """
    from ..storage import materialize

    by = [*keys, *order]
    rows = events.select(*by, value.alias("__v")).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    cut = materialize(rows.select(*keys, "__v", "__at")).withColumn("__piece", F.floor(F.col("__at") / CHUNK))
    pieces = cut.groupBy(*keys, "__piece").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__v").alias("v")))).alias("__events"))
    return pieces.withColumn("__first", F.col("__piece") == F.min("__piece").over(Window.partitionBy(*keys)))


def _in_order(pieces: DataFrame, keys: list[str], what: Column) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__piece", what.alias("x")))).alias("__all"))


def bias_fold(events: DataFrame, user: str, signal: str, delta: str, order: list[str]) -> DataFrame:
    """Per user and signal the sum of feedback, held within LIMIT after every step (so order counts).

    A step held within bounds is x -> min(hi, max(lo, x + a)), and one such step after another is a step of the same form: so a piece of the events is three numbers, whatever came before it.
    """
    held = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))
    low, high = F.lit(-LIMIT), F.lit(LIMIT)
    step = lambda s, e: F.struct((s["a"] + e["v"]).alias("a"), held(s["lo"] + e["v"], low, high).alias("lo"), held(s["hi"] + e["v"], low, high).alias("hi"))
    # the first step's own bounds hold whatever it is given, so it begins from them
    start = F.struct(F.lit(0).alias("a"), low.alias("lo"), high.alias("hi"))
    pieces = _pieces(events, [user, signal], order, F.col(delta).cast("int"))
    whole = _in_order(pieces, [user, signal], F.aggregate("__events", start, step))
    return whole.select(user, signal, F.aggregate("__all", F.lit(0), lambda x, p: held(x + p["x"]["a"], p["x"]["lo"], p["x"]["hi"])).alias("bias"))


def _fold(events: DataFrame, keys: list[str], order: list[str], kind: str, states: int, step) -> DataFrame:
    """keys and ``s``, the number of the state that ``step(state, kind)`` leads to from state 0.  A later piece is folded from each of the ``states`` states, as it isn't known which one it starts from."""
    pieces = _pieces(events, keys, order, F.col(kind))
    run = lambda s0: F.aggregate("__events", s0.cast("int"), lambda s, e: step(s, e["v"]).cast("int"))
    led = F.when(F.col("__first"), F.array(run(F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(states - 1)), run))
    whole = _in_order(pieces, keys, led)
    return whole.select(*keys, F.aggregate("__all", F.lit(0), lambda s, p: F.get(p["x"], s)).alias("s"))


def marks(events: DataFrame, user: str, item: str, kind: str, order: list[str]) -> DataFrame:
    """saved, attending, dismissed, tracked and feedback of each user's item after its events in order.

    Kinds: save, attend, dismiss and track toggle their mark; saving always takes a dismissal back, attending does when it is set, dismissing takes saved
    and attending away when it is set.  more and less are feedback; less also dismisses.
    """
    bit = lambda s, n: F.getbit(s, F.lit(n)) == 1

    def step(s, k):
        is_ = lambda x: F.coalesce(k == x, F.lit(False))
        was_saved, was_going, was_gone, was_tracked = (bit(s, n) for n in range(4))
        less = is_("less")
        gone = (is_("dismiss") & ~was_gone) | less
        going = is_("attend") & ~was_going
        saved = F.when(is_("save"), ~was_saved).when(gone, F.lit(False)).otherwise(was_saved)
        attending = F.when(is_("attend"), ~was_going).when(gone, F.lit(False)).otherwise(was_going)
        dismissed = F.when(is_("dismiss"), ~was_gone).when(less, F.lit(True)).when(is_("save") | going, F.lit(False)).otherwise(was_gone)
        tracked = F.when(is_("track"), ~was_tracked).otherwise(was_tracked)
        told = F.when(is_("more"), 1).when(less, 2).otherwise(F.shiftright(s, 4))
        return sum((F.when(c, 1 << n).otherwise(0) for n, c in enumerate((saved, attending, dismissed, tracked))), told * 16)

    found = _fold(events, [user, item], order, kind, 48, step)
    told = F.shiftright("s", 4)
    return found.select(user, item, *[bit(F.col("s"), n).alias(m) for n, m in enumerate(LISTS)], F.when(told == 1, "more").when(told == 2, "less").alias("feedback"))


def toggles(events: DataFrame, user: str, item: str, kind: str, order: list[str]) -> DataFrame:
    """saved and dismissed alone, as studies have them: each toggles and takes the other away."""
    step = lambda s, k: F.when(k == "save", F.when(s == 1, 0).otherwise(1)).when(k == "dismiss", F.when(s == 2, 0).otherwise(2)).otherwise(s)
    found = _fold(events, [user, item], order, kind, 3, step)
    return found.select(user, item, (F.col("s") == 1).alias("saved"), (F.col("s") == 2).alias("dismissed"))


def feedback_deltas(events: DataFrame, signals: str, kind: str) -> DataFrame:
    """A row for each signal of each piece of feedback (more, less), with its ``delta``."""
    return events.where(F.col(kind).isin("more", "less")).withColumn("signal", F.explode(signals)).withColumn("delta", F.when(F.col(kind) == "more", STEP).otherwise(-STEP))


def watched(events: DataFrame, user: str, listing: str, name: str) -> DataFrame:
    """Names on each user's lists (authors, companies, organizers, categories, interests): those toggled an odd number of times, trimmed and in lower case; blank names count for nothing."""
    key = F.lower(F.trim(name))
    n = events.withColumn("name", key).where("name <> ''").groupBy(user, listing, "name").agg(F.count("*").alias("n"))
    return n.where("n % 2 = 1").drop("n")


def _client(records: DataFrame, client: str) -> Column:
    """What client ids are ordered by."""
    from ..functions.text import by_locale

    return by_locale(F.col(client)).alias("__client") if records.schema[client].dataType.typeName() == "string" else F.col(client)


def last_writer(records: DataFrame, key: str, stamp: str, client: str, value: str) -> DataFrame:
    """The record with the latest stamp, then the largest client id."""
    return records.groupBy(key).agg(F.max_by(value, F.struct(stamp, _client(records, client))).alias(value), F.max(stamp).alias(stamp))


def reconcile_records(records: DataFrame, key: str, stamp: str, client: str, visit: str) -> DataFrame:
    """One record of each key from all sides: the last writer's, with the latest ``visit`` of any side, since a visit is never undone."""
    names = [c for c in records.columns if c not in (key, visit)]
    best = records.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(stamp, _client(records, client))).alias("r"), F.max(visit).alias(visit))
    return best.select(key, "r.*", visit)


def clear_all(records: DataFrame, keys: DataFrame, key: str, stamp: str, clock: Column, state: str = "state") -> DataFrame:
    """``records`` with those of ``keys`` emptied: what is left is an empty state with a newer stamp, which wins over copies on other clients, as a deleted row would not."""
    gone = F.coalesce(F.col("__gone"), F.lit(False))
    rows = records.join(keys.select(key, F.lit(True).alias("__gone")).distinct(), key, "left")
    empty = parse_state(F.lit("{}")) if records.schema[state].dataType.typeName() == "struct" else F.lit("{}")
    return rows.withColumns({state: F.when(gone, empty).otherwise(F.col(state)), stamp: F.when(gone, F.greatest(clock, F.col(stamp) + 1)).otherwise(F.col(stamp))}).drop("__gone").select(*records.columns)


def apply_remote(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """The remote record, unless the local one is newer; records of one side alone stay."""
    names = [c for c in local.columns if c != key]
    both = local.alias("l").join(remote.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    newer = F.col(f"r.{stamp}").isNull() | (F.col(f"l.{stamp}") > F.col(f"r.{stamp}"))
    return both.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), *[F.when(newer, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in names])


def mint_stamps(writes: DataFrame, user: str, clock: str, order: str) -> DataFrame:
    """``stamp`` of each write: its clock, or one more than the largest stamp before it where the clock has not moved on."""
    w = Window.partitionBy(user).orderBy(order)
    place = F.row_number().over(w)
    return writes.withColumn("__n", place).withColumn("stamp", F.max(F.col(clock) - F.col("__n")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__n")).drop("__n")


def previous_visit(visits: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """``previous``: the visit before each, by time and then ``tie``."""
    return visits.withColumn("previous", F.lag(ts).over(Window.partitionBy(user).orderBy(ts, tie)))


def unique_strings(x: Column, most: int = 2000, length: int = 256) -> Column:
    return F.slice(F.array_distinct(F.filter(x, lambda s: s.isNotNull() & (s != "") & (F.length(s) <= length))), 1, most)


_NAMED = ["authors", "companies", "preferred_categories", "campus_interests", "followed_organizers"]
STATE = (
    "schema_version int, last_visit string, " + ", ".join(f"{x} array<string>" for x in [*LISTS, *_NAMED]) + ", feedback map<string,string>, bias map<string,double>, updated_at_ms bigint, client_id string"
)
EMPTY = "array()"


def parse_state(text: Column) -> Column:
    """Total parse: anything malformed becomes the empty state; biases are held within LIMIT, feedback is more or less, watched names are in lower case."""
    s = F.from_json(text, STATE)
    strings = lambda c: F.filter(F.coalesce(s[c], F.array().cast("array<string>")), lambda x: x.isNotNull())
    low = lambda c: F.transform(strings(c), lambda x: F.lower(x)) if c in ("authors", "companies", "followed_organizers") else strings(c)
    bias = F.transform_values(F.map_filter(F.coalesce(s["bias"], F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull() & ~F.isnan(v)), lambda k, v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), v)).cast("double"))
    feedback = F.map_filter(F.coalesce(s["feedback"], F.create_map().cast("map<string,string>")), lambda k, v: v.isin("more", "less"))
    return F.struct(
        s["last_visit"].alias("last_visit"), *[strings(c).alias(c) for c in LISTS], *[low(c).alias(c) for c in _NAMED], feedback.alias("feedback"), bias.alias("bias"),
        F.coalesce(s["updated_at_ms"], F.lit(0)).cast("long").alias("updated_at_ms"), s["client_id"].alias("client_id"),
    )


def valid_record(text: Column) -> Column:
    """Whether a stored record has the known schema version and a stamp from zero."""
    s = F.from_json(text, STATE)
    return F.coalesce((s["schema_version"] == 1) & (s["updated_at_ms"] >= 0), F.lit(False))


def has_content(s: Column) -> Column:
    """Whether a parsed state holds anything of a person's, visits aside."""
    lists = [F.size(s[c]) > 0 for c in [*LISTS, *_NAMED, "feedback", "bias"]]
    out = lists[0]
    for x in lists[1:]:
        out = out | x
    return out


FILTERS = "query string, min_rate string, min_total string, max_hours string, mode string, sort string, tags array<string>, eligible_only boolean, show_dismissed boolean"


def parse_filters(text: Column) -> Column:
    """Filters of the studies list; unknown choices become the default ones."""
    f = F.from_json(text, FILTERS)
    one_of = lambda c, options: F.when(f[c].isin(*options), f[c]).otherwise(options[0])
    words = lambda c, other: F.coalesce(f[c], F.lit(other))
    tags = unique_strings(F.coalesce(f["tags"], F.array().cast("array<string>")), 100)
    return F.struct(
        F.substring(words("query", ""), 1, 300).alias("query"), words("min_rate", "0").alias("min_rate"), words("min_total", "0").alias("min_total"), words("max_hours", "").alias("max_hours"),
        one_of("mode", ["any", "online", "inperson"]).alias("mode"), one_of("sort", ["rate", "total", "time", "new"]).alias("sort"), tags.alias("tags"),
        F.coalesce(f["eligible_only"], F.lit(False)).alias("eligible_only"), F.coalesce(f["show_dismissed"], F.lit(False)).alias("show_dismissed"),
    )


ANSWERS = ["right_handed", "mri_safe", "cardiovascular", "pregnant", "seizure", "fasting", "student"]
PROFILE = "age double, sex string, " + ", ".join(f"{a} boolean" for a in ANSWERS)


def parse_profile(text: Column) -> Column:
    """Answers of a stored profile of any version: the first kept them bare, the second inside ``profile``.  Ages are whole numbers from 0 to 120; anything else is unanswered."""
    e = F.from_json(text, f"v int, profile struct<{', '.join(x.replace(' ', ':', 1) for x in PROFILE.split(', '))}>, {PROFILE}")
    held = e["profile"].isNotNull()
    pick = lambda c: F.when(held, e["profile"][c]).otherwise(e[c])
    age, sex = pick("age"), pick("sex")
    return F.struct(
        F.when((age >= 0) & (age <= 120) & (F.floor(age) == age), age.cast("int")).alias("age"), F.when(sex.isin("male", "female", "other"), sex).alias("sex"), *[pick(a).alias(a) for a in ANSWERS]
    )


def valid_write(old_stamp: Column, new_stamp: Column, size: Column, most: int = 1 << 20) -> Column:
    return (new_stamp > F.coalesce(old_stamp, F.lit(0))) & (size <= most)


def vault_faults(text: Column, old_stamp: Column, most: int = 1 << 20) -> Column:
    """Why a record may not be written: malformed, unknown keys, size, list sizes, a stamp that does not move on.  Empty: it may."""
    known = ["schema_version", "last_visit", *LISTS, *_NAMED, "feedback", "bias", "updated_at_ms", "client_id"]
    s, keys = F.from_json(text, STATE), F.json_object_keys(text)
    long_ = [F.coalesce(F.size(s[c]) > 2000, F.lit(False)) for c in [*LISTS, *_NAMED]]
    many = long_[0]
    for x in long_[1:]:
        many = many | x
    faults = [
        (keys.isNull() | ~valid_record(text), "malformed"), (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0, "unknown keys"), (F.octet_length(text) > most, "too large"), (many, "lists too long"),
        (F.length(s["client_id"]) > 128, "client id too long"), (s["updated_at_ms"] <= F.coalesce(old_stamp, F.lit(-1)), "stamp does not move on"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(w)) for c, w in faults]))


def profile_answers(p: dict[str, Column]) -> Column:
    """How many answers are given."""
    return F.size(F.array_compact(F.array(*[c.cast("string") for c in p.values()])))


def export(rows: DataFrame, column: str) -> DataFrame:
    """The state as JSON text, as ``parse_state`` reads it."""
    return rows.withColumn(column, F.to_json(column))
