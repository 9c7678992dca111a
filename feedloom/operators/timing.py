"""Time that a paid study takes, from free text: contact hours, sessions, calendar span.  Calendar units never become hours.

The text is brought to one spelling, its spans of time and its counts of visits are read with their places, and then either a stated total
is taken or every span is multiplied by the count that belongs to it and the products are added.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pay import plain_text

FIELDS = {"total_hours_min": T.DoubleType(), "total_hours_max": T.DoubleType(), "session_count": T.IntegerType(), "span_weeks": T.DoubleType(), "confidence": T.StringType()}
#: Hours or weeks in a unit.
HOURS, WEEKS = {"minute": 1 / 60, "hour": 1.0}, {"day": 1 / 7, "week": 1.0, "month": 4.348, "year": 52.179}
SHORT = {"min": "minute", "hr": "hour", "wk": "week"}
MOST_HOURS, MOST_WEEKS, MOST_SESSIONS = 2000, 520, 500
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}
NUMBERS |= {w: 10 * i for i, w in enumerate("thirty forty fifty sixty seventy eighty ninety".split(), 3)}
# How listings speak of visits, totals and single visits.
UNIT = r"(?:hour|hr|minute|min|week|wk|day|month|year)s?"
NOUN = r"(?:visits?|sessions?|appointments?|study\s+days?|lab\s+visits?|interviews?|scans?|workshops?|interventions?|assessments?|phases?|parts?|meetings?|classes?)"
COUNT = re.compile(rf"(\d+)\s+((?:(?!{UNIT}\b)\w+\s+){{0,2}}?){NOUN}\b")
SPAN = re.compile(r"(\d+(?:\.\d+)?)\s*(?:(?:-|to|through)\s*(\d+(?:\.\d+)?)\s*)?(hour|hr|minute|min|week|wk|day|month|year)s?\b")
TOTAL = re.compile(
    r"\b(?:total|totaling|in all|altogether|combined|entire (?:study|session|experiment|protocol)|whole study|study (?:involvement|participation)|(?:overall|cumulative) (?:time|duration)|"
    r"participation is|completing this[^.;]{0,60}?takes)\b"
)
SPLIT_UP = re.compile(
    r"[\s,:-]*(?:\(|across|split|divided|spread|broken|consisting of|comprised of|composed of|made up of|in the form of|in (?:\d+|a|two|three) [a-z]* ?(?:visits?|sessions?|parts?)|over \d+ (?:visits?|sessions?))"
)
EACH_NOUN, EACH_NEXT = re.compile(rf"\b(?:each|per|every|apiece)\s+(?:\w+\s+){{0,2}}?{NOUN}\b"), re.compile(r"[\s,)]*(?:each|apiece|per\s+\w+)\b")
EACH_JUST, EACH = re.compile(r"\b(?:each|every|apiece)\b[^.;]{0,20}$"), re.compile(r"\b(?:each|per|every|apiece)\b")
LISTED = re.compile(rf"\b(?:each|every|per)\s+(?:\w+\s+){{0,2}}?{NOUN}\s*\(\s*(\d+(?:\s*,\s*(?:and\s+)?\d+){{2,}})\s*\)")
GAP = r"[\s,:()\[\]-]"
LINK = re.compile(
    rf"{GAP}*(?:(?:lasting|lasts|last|for|of|at|about|approximately|approx|around|roughly|up|to|each|per|taking|takes|take|which|that|will|is|are|be|expected|estimated|requiring|requires|require|"
    rf"maximum|minimum|max|min|anticipated|a|an|the)\b{GAP}*)*"
)
OPEN_ENDED = re.compile(r"\b(?:several|a few|few|some|varying|numerous|multiple)\s+(?:minutes?|mins?|hours?|hrs?)\b[^.;]{0,60}?\b(?:each|every|per)\s+(?:day|week|morning|evening|night|session|visit)\b")


def one_spelling(markup: str | None) -> str:
    t = re.sub(r"(?i)<\s*(?:br\s*/?|/\s*(?:p|div|li|tr|h[1-6]))\s*>", " ; ", markup or "")
    t = re.sub("[‐‑‒–—―−]", "-", plain_text(t).lower()).replace("~", " ")
    t = re.sub(rf"\b({UNIT})(\d)", r"\1 \2", t)
    t = re.sub(rf"(\d)(?={UNIT}\b)", r"\1 ", t)
    t = t.replace("half an hour", "30 minutes")
    t = re.sub(r"\b(?:an? |one )?(hour|week|month|day|year) and a half\b", r"1.5 \1s", t)
    t = re.sub(r"\bone and a half (hours?|weeks?|months?|days?|years?)\b", r"1.5 \1", t)
    t = re.sub(r"\ban?\s+(hour|hr|minute|min|week|day|month|year)s?\b", r"1 \1", t)
    t = re.sub(r"\b[a-z]+\b", lambda m: str(NUMBERS.get(m[0], m[0])), t)
    t = re.sub(rf"(\d(?:\.\d+)?)\s*-\s*(?=(?:hour|hr|minute|min|week|wk|day|month|year)|{NOUN})", r"\1 ", t)
    return re.sub(r"\s+", " ", t).strip()


class Span(NamedTuple):
    low: float
    high: float
    unit: str
    at: int
    end: int

    @property
    def hours(self) -> bool:
        return self.unit in HOURS


class Count(NamedTuple):
    n: int
    at: int
    end: int


def spans(t: str) -> list[Span]:
    """Spans of time; "1 hour to 90 minutes" is one range, "1 hour 15 minutes" one sum."""
    out: list[Span] = []
    for m in SPAN.finditer(t):
        unit = SHORT.get(m[3], m[3])
        size = HOURS.get(unit) or WEEKS[unit]
        a, b = float(m[1]) * size, float(m[2] or m[1]) * size
        new = Span(min(a, b), max(a, b), unit, m.start(), m.end())
        if out:
            last, gap = out[-1], t[out[-1].end : new.at]
            if last.hours == new.hours and last.low == last.high and re.fullmatch(r"\s*(?:-|to|through|up to)\s*", gap):
                out[-1] = last._replace(low=min(last.low, new.low), high=max(last.high, new.high), end=new.end)
                continue
            if (last.unit, new.unit) == ("hour", "minute") and re.fullmatch(r"\s*(?:and\s+)?", gap):
                out[-1] = last._replace(low=last.low + new.low, high=last.high + new.high, end=new.end)
                continue
        out.append(new)
    return out


def counts(t: str) -> list[Count]:
    return [Count(int(m[1]), m.start(), m.end()) for m in COUNT.finditer(t) if int(m[1]) >= 1]


def sessions(t: str, found: list[Count]) -> int | None:
    """All counts of visits added; or a count before its own length ("two 2-hour sessions"); or how many are labelled ("Visit 1:")."""
    if found:
        n = sum(c.n for c in found)
        return n if n <= MOST_SESSIONS else None
    m = re.search(rf"(\d+)\s+(?:\w+\s+){{0,2}}?\d+(?:\.\d+)?\s*(?:hours?|hrs?|minutes?|mins?)\s+{NOUN}\b", t)
    if m and 1 <= int(m[1]) <= MOST_SESSIONS:
        return int(m[1])
    return len(set(re.findall(r"\b(visit|session|phase|appointment|part)\s*(\d+)\s*[:)]", t))) or None


@dataclass
class Hours:
    low: float | None = None
    high: float | None = None
    how: str = "none"
    vague: bool = False
    used: list[int] = field(default_factory=list)
    spare: list[int] = field(default_factory=list)


class Time:
    """One text.  ``licensed``: a number of visits that the pay tells; it frees a multiplication that the text alone leaves open."""

    def __init__(self, t: str, licensed: int | None = None):
        self.t, self.licensed = t, licensed
        self.spans, self.counts = spans(t), counts(t)
        self.timed = [s for s in self.spans if s.hours]
        self.sessions = sessions(t, self.counts)

    def clause(self, at: int) -> str:
        a = max(self.t.rfind(".", 0, at + 1), self.t.rfind(";", 0, at + 1)) + 1
        ends = [e for e in (self.t.find(".", at), self.t.find(";", at)) if e >= 0]
        return self.t[a : min(ends, default=len(self.t))]

    def count_ahead(self, at: int, reach: int) -> int | None:
        near = [int(m[1]) for m in COUNT.finditer(self.t[max(0, at - reach) : at]) if 1 <= int(m[1]) <= MOST_SESSIONS]
        return near[-1] if near else None

    def listed(self, s: Span) -> int | None:
        m = LISTED.search(self.clause(s.at))
        n = len(re.findall(r"\d+", m[1])) if m else 0
        return n if 2 <= n <= MOST_SESSIONS else None

    def neighbour(self, s: Span) -> tuple[int, bool] | None:
        """(the last count before a span, whether nothing but linking words stands between and no other span shares it)."""
        ahead = [i for i, c in enumerate(self.counts) if c.end <= s.at]
        if not ahead or not 2 <= self.counts[ahead[-1]].n <= MOST_SESSIONS:
            return None
        c = self.counts[ahead[-1]]
        end = self.counts[ahead[-1] + 1].at if ahead[-1] + 1 < len(self.counts) else len(self.t)
        alone = sum(c.end <= x.at < end for x in self.timed) <= 1
        return c.n, alone and s.at - c.end <= 45 and LINK.fullmatch(self.t[c.end : s.at]) is not None

    def times(self, s: Span) -> tuple[int, bool, int | None]:
        """(factor, whether a count beside it was left out, that count if a neighbour)."""
        ahead, behind = self.t[max(0, s.at - 60) : s.at].replace("each other", ""), self.t[s.end : s.end + 40]
        if EACH_NEXT.match(behind) or EACH_NOUN.search(ahead) or EACH_JUST.search(ahead):
            return max(1, self.listed(s) or self.count_ahead(s.at, 120) or self.sessions or 1), False, None
        straddles = re.search(r"(\d+)\s+(?:\w+\s+){0,2}$", self.t[max(0, s.at - 60) : s.at])
        if straddles and re.match(rf"[\s,]*{NOUN}\b", behind) and 1 < int(straddles[1]) <= MOST_SESSIONS:
            return int(straddles[1]), False, None
        if n := self.listed(s):
            return n, False, None
        beside = self.neighbour(s)
        if beside and (beside[1] or beside[0] == self.licensed):
            return beside[0], False, None
        return 1, (self.count_ahead(s.at, 45) or 0) > 1, beside[0] if beside else None

    def total(self) -> Span | None:
        for s in self.timed:
            if re.match(r"[\s,)]*(?:hours?|hrs?)?\s*(?:in )?total\b", self.t[s.end : s.end + 20]):
                return s
        return next((s for s in self.timed if TOTAL.search(self.clause(s.at))), None)

    def hours(self) -> Hours:
        if not self.timed:
            return Hours()
        if s := self.total():
            return Hours(s.low, s.high, "total")
        first = self.timed[0]
        if len(self.timed) > 1 and first.at <= 40 and SPLIT_UP.match(self.t[first.end : first.end + 30]):
            return Hours(first.low, first.high, "total")
        if OPEN_ENDED.search(self.t):
            return Hours(how="open", vague=True)
        out, n = Hours(0.0, 0.0, "single" if len(self.timed) == 1 else "summed"), 0
        for s in self.timed:
            if re.search(r"\bexcept\b", self.t[max(0, s.at - 70) : s.at]):
                continue  # restates a part of what is counted
            factor, left, spare = self.times(s)
            n, out.low, out.high, out.vague = n + 1, out.low + factor * s.low, out.high + factor * s.high, out.vague or left
            out.used += [factor] if factor > 1 else []
            out.spare += [spare] if spare is not None else []
        if self.sessions == n:
            out.vague = False  # one span for each visit
        if not out.used and EACH.search(self.t.replace("each other", "")):
            out.vague = True
        if out.used:
            out.how = "multiplied"
        if out.high <= 0:
            out.low = out.high = None
            out.how = "none"
        return out

    def weeks(self) -> float | None:
        found = [s.high for s in self.spans if not s.hours and 0 < s.high <= MOST_WEEKS]
        return int(max(found) * 100 + 0.5) / 100 if found else None

    def read(self) -> tuple[dict, Hours]:
        if not self.t:
            return dict.fromkeys(FIELDS) | {"confidence": "low"}, Hours()
        h, weeks = self.hours(), self.weeks()
        low, high = (h.low, h.high) if h.high is not None and 0 < h.high <= MOST_HOURS else (None, None)
        out = {"total_hours_min": low and round(low, 4), "total_hours_max": high and round(high, 4), "session_count": self.sessions, "span_weeks": weeks}
        return out | {"confidence": self.sure(h, high, weeks)}, h

    def sure(self, h: Hours, high: float | None, weeks: float | None) -> str:
        if h.how == "none":
            return "low" if weeks is None else "medium"
        floor_only = h.how == "single" and re.search(r"\b(?:visits|sessions|appointments)\b", self.t) and not re.search(r"\b\d+\s+(?:\w+\s+){0,2}?(?:visits?|sessions?|appointments?)\b", self.t)
        if high is None or h.vague or floor_only:
            return "low"
        many = len(self.spans)
        return {"total": "high", "single": "high" if many <= 2 else "medium", "multiplied": "medium", "summed": "low" if many >= 5 else "medium"}.get(h.how, "low")


def duration(markup: str | None) -> dict:
    return Time(one_spelling(markup)).read()[0]


def implied_visits(pay: dict) -> int | None:
    """Visits by the pay: as stated, or how often the sum for one fits into the whole less the bonus."""
    stated = pay.get("visit_count")
    if stated and 1 <= stated <= MOST_SESSIONS:
        return int(stated)
    each, whole = pay.get("per_visit"), pay.get("guaranteed_max") if pay.get("guaranteed_max") is not None else pay.get("guaranteed_min")
    if not each or not whole:
        return None
    rest = whole - (pay.get("completion_bonus") or 0)
    n = int(rest // each)
    return n if rest >= each and 1 <= n <= MOST_SESSIONS else None


def duration_with_pay(markup: str | None, pay: dict) -> dict:
    """The text's reading, with a number of visits that the pay confirms (surer), supplies (for a count left out) or denies (less sure)."""
    t = one_spelling(markup)
    out, h = Time(t).read()
    n = implied_visits(pay)
    more = {"low": "medium", "medium": "high", "high": "high"}
    if n is None or n < 2:
        return out
    if n in h.spare:
        freed, g = Time(t, n).read()
        return freed | {"confidence": more[freed["confidence"]]} if n in g.used else out
    if n in h.used:
        return out | {"confidence": more[out["confidence"]]}
    return out | {"confidence": "low"} if h.how == "multiplied" and pay.get("visit_count") and h.used else out


SCHEMA = T.StructType([T.StructField(k, t) for k, t in FIELDS.items()])


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(FIELDS)).astype({"session_count": "Int32"})


@F.pandas_udf(SCHEMA)
def parse_duration(s: pd.Series) -> pd.DataFrame:
    return frame([duration(x) for x in s])
