"""Classifiers over padded phrase tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_words, has_any, has_piece, let
from ..rules import lexicons as L

PROXIMITY = 60


def companies(hay: Column, names: list[str] | None = None, most: int = 5) -> Column:
    """Names in a padded text, without those inside another hit."""
    found = let(hay, lambda h: F.filter(_likely(h, names or L.COMPANIES), lambda n: F.contains(h, F.concat(F.lit(" "), n, F.lit(" ")))))
    return let(found, lambda hits: F.slice(F.filter(hits, lambda n: ~F.exists(hits, lambda m: (m != n) & F.contains(m, n))), 1, most))


def category(hay: Column, owner: Column, named: Column, types: Column | None = None) -> Column:
    """sports, companies, deadline, research, academic, clubs or community: the first rule that holds.  ``types``: the event types, padded."""
    own = F.lower(F.coalesce(owner, F.lit("")))
    athletic = F.contains(own, F.lit(L.ATHLETICS))
    if types is not None:
        athletic = athletic | F.contains(types, F.lit(" athletics "))

    def rules(h: Column, seen: Column) -> Column:
        any_of = lambda xs: has_any(h, xs, seen)
        out = F.when(athletic, "sports").when(F.size(named) > 0, "companies").when(any_of(L.RECRUITING), "companies")
        out = out.when(any_of(L.SPORTS), "sports").when(any_of(L.DEADLINES), "deadline").when(any_of(L.RESEARCH), "research")
        for mark, c in L.OWNERS.items():  # in the rules' order
            out = out.when(F.contains(own, F.lit(mark)), c)
        return out.when(any_of(L.ACADEMIC), "academic").when(any_of(L.CLUBS), "clubs").otherwise("community")

    phrases = [*L.RECRUITING, *L.SPORTS, *L.DEADLINES, *L.RESEARCH, *L.ACADEMIC, *L.CLUBS]
    return let(hay, lambda h: let(first_words(h, phrases), lambda seen: rules(h, seen)))


def intramural(hay: Column, owner: Column, tags: Column) -> Column:
    """A concrete event that names intramurals, or that the recreation department owns and tags ``im`` or names an activity for."""
    ours = F.contains(F.lower(F.coalesce(owner, F.lit(""))), F.lit(L.RECREATION))
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)) == "im")
    named = has_any(hay, L.INTRAMURAL)
    return has_any(hay, L.CONCRETE) & (named | (ours & (F.coalesce(tagged, F.lit(False)) | has_any(hay, L.ACTIVITIES))))


# How a listing that looks for participants speaks, and the context that makes it a study.
_SEEKS = [
    "participant needed", "participants needed", "seeking participant", "seeking participants", "recruiting participant", "recruiting participants", "volunteer needed", "volunteers needed",
    *[f"{x} {y} study" for x in ("take part in", "participate in") for y in ("a", "our", "this")],
    "study participant", "study participants", "paid study", "clinical trial participant", "clinical trial participants",
]
_STUDY = ["research study", "clinical trial", "human subject", "human subjects", "irb", "compensation", "paid", "participant"]


def seeks_participants(title: Column, summary: Column, tags: Column, pay: Column, source: Column, registry: str) -> Column:
    """Listings that another vertical owns: those of the study registry, and those that recruit participants for a study."""
    t = F.regexp_replace(F.lower(F.concat_ws(" ", title, summary, F.array_join(tags, " "), pay)), "[^a-z0-9$]+", " ")
    words = F.concat(F.lit(" "), F.replace(t, F.lit("$"), F.lit(" $ ")), F.lit(" "))  # each between spaces: whole phrases need no pattern
    has = lambda h, xs: has_piece(h, [f" {x} " for x in xs])
    return F.coalesce(source == registry, F.lit(False)) | F.coalesce(let(words, lambda h: has(h, _SEEKS) & has(h, _STUDY)), F.lit(False))


def _likely(hay: Column, terms: list[str], seen: Column | None = None) -> Column:
    """Those of ``terms``, in their order, whose first word is one of the padded text's: one pass over the words for all terms, so that few are left to look for.  ``seen``: as in ``has_any``."""
    each = F.array(*[F.struct(F.lit(x.split(" ")[0]).alias("first"), F.lit(x).alias("term")) for x in terms])
    return let(first_words(hay, terms) if seen is None else seen, lambda seen: F.when(F.size(seen) > 0, F.transform(F.filter(each, lambda x: F.array_contains(seen, x["first"])), lambda x: x["term"])).otherwise(F.array().cast("array<string>")))


def _found(hay: Column, terms: list[str], seen: Column | None = None) -> Column:
    """(at, term) of the first place of each term that occurs, in order of place."""
    at = F.transform(_likely(hay, terms, seen), lambda x: F.struct(F.position(F.concat(F.lit(" "), x, F.lit(" ")), hay).alias("at"), x.alias("term")))
    return F.array_sort(F.filter(at, lambda x: x["at"] > 0))


def food_rank(tier: Column) -> Column:
    """How good the evidence is, for choosing among several."""
    return F.when(tier == "confirmed", 3).when(tier == "provided", 2).when(tier == "mentioned", 1).otherwise(0)


def freebies(hay: Column, cost: Column | None = None) -> Column:
    """struct(tier, items, evidence, swag, chance) of a padded text.  Evidence is the text around the words that decided."""
    names = lambda h, seen, xs: F.transform(_found(h, xs, seen), lambda x: x["term"])
    first = lambda h, seen, xs: F.try_element_at(F.filter(F.transform(_likely(h, xs, seen), lambda x: F.position(F.concat(F.lit(" "), x, F.lit(" ")), h)), lambda p: p > 0), F.lit(1))

    def judged(h: Column, seen: Column, v: Column) -> Column:
        foods, free, served = v["foods"], v["free"], v["served"]
        near = lambda p: F.coalesce(F.exists(foods, lambda f: F.abs(f["at"] - p) <= PROXIMITY), F.lit(False))
        start = F.try_element_at(foods, F.lit(1))["at"]
        tier = F.when(F.size(foods) == 0, "none").when(near(free), "confirmed").when(near(served), "provided")
        if cost is not None:
            tier = tier.when(F.coalesce(F.lower(cost).contains("free"), F.lit(False)), "provided")
        at = F.when(near(free), F.least(free, start)).when(near(served), F.least(served, start)).otherwise(start)
        return F.struct(
            tier.otherwise("mentioned").alias("tier"), F.slice(F.transform(foods, lambda f: f["term"]), 1, 6).alias("items"), F.when(F.size(foods) > 0, evidence(h, at)).alias("evidence"),
            names(h, seen, L.SWAG).alias("swag"), names(h, seen, L.CHANCE).alias("chance"),
        )

    found = lambda h, seen: F.struct(_found(h, L.FOOD, seen).alias("foods"), first(h, seen, L.FREE).alias("free"), first(h, seen, L.PROVIDED).alias("served"))
    words = [*L.FOOD, *L.FREE, *L.PROVIDED, *L.SWAG, *L.CHANCE]
    return let(hay, lambda h: let(first_words(h, words), lambda seen: let(found(h, seen), lambda v: judged(h, seen, v))))


def is_free(found: Column) -> Column:
    return found["tier"].isin("confirmed", "provided") | (F.size(found["swag"]) > 0)


def evidence(text: Column, at: Column, before: int = 40, after: int = 70) -> Column:
    """The text from ``before`` signs ahead of a place (from 1) to ``after`` signs behind it."""
    begin = F.greatest(F.lit(1), at - before)
    return F.trim(F.substring(text, begin, at + after - begin))
