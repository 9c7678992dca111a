"""A first letter to a study's team: what a person may state, what they should raise, and the link that opens the draft."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import EMAIL, looks_like_email, url_component

SUBJECT, LINK = 64, 2000


def scrub(text: Column, marker: str = "[email hidden]") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, marker.replace("$", r"\$"))


def short_title(title: Column, most: int = SUBJECT) -> Column:
    t = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    head = F.substring(t, 1, most)
    word = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    cut = F.regexp_replace(F.when(F.length(word) > most * 0.6, word).otherwise(head), r"[,;:.\-\s]+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def greeting(name: Column) -> Column:
    n = F.regexp_replace(F.trim(name), r"\s+", " ")
    return F.when(F.coalesce(n, F.lit("")).isin("") | looks_like_email(n), "Dear study team,").otherwise(F.concat(F.lit("Dear "), n, F.lit(",")))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _ages(e: Column) -> Column:
    low = e["min_age"].cast("string")
    return F.when(e["max_age"].isNull(), F.concat(low, F.lit(" and over"))).otherwise(F.concat(low, F.lit("-"), e["max_age"].cast("string")))


def _flagged(e: Column, pattern: str) -> Column:
    return F.exists(e["flags"], lambda f: f.rlike(f"(?i){pattern}"))


def confirmations(e: Column, p: Column) -> Column:
    """Criteria that the profile meets, in the first person.  e and p as in ``eligible``."""
    inside = (p["age"] >= e["min_age"]) & (e["max_age"].isNull() | (p["age"] <= e["max_age"]))
    said = [
        (inside, F.concat(F.lit("I am "), p["age"].cast("string"), F.lit(", which is within the listed ages "), _ages(e), F.lit("."))), (e["right_handed"] & p["right_handed"], F.lit("I am right-handed.")),
        (e["mri_safe"] & p["mri_safe"], F.lit("As far as I know an MRI is safe for me; you will want to screen me yourselves.")), (e["fasting"] & p["fasting"], F.lit("I can fast before a visit.")),
        (e["sex"] == p["sex"], F.concat(F.lit("I am "), e["sex"], F.lit(", as the listing asks."))), (e["no_cardiovascular"] & ~p["cardiovascular"], F.lit("I have no cardiovascular condition.")),
        (e["no_pregnancy"] & ~p["pregnant"], F.lit("I am not pregnant.")), (e["no_seizure"] & ~p["seizure"], F.lit("I have never had seizures or epilepsy.")),
        (_flagged(e, "subject-pool") & p["student"], F.lit("I am a student here.")), (_flagged(e, "non-students only") & ~p["student"], F.lit("I am not a student here.")),
    ]
    return F.array_compact(F.array(*[F.when(_yes(c), t) for c, t in said]))


def disclosures(e: Column, p: Column) -> Column:
    """What a person should raise before screening does: conflicts, and conditions that the text touches even where it is no clear criterion."""
    age = p["age"].cast("string")
    said = [
        (p["age"] < e["min_age"], F.concat(F.lit("I am "), age, F.lit(", below the listed minimum of "), e["min_age"].cast("string"), F.lit("."))),
        (p["age"] > e["max_age"], F.concat(F.lit("I am "), age, F.lit(", above the listed maximum of "), e["max_age"].cast("string"), F.lit("."))),
        (p["pregnant"] & (e["no_pregnancy"] | _flagged(e, "pregnan|lactat")), F.lit("I am pregnant.")),
        (p["cardiovascular"] & (e["no_cardiovascular"] | _flagged(e, "cardiovascular|cardiac|heart")), F.lit("I have a cardiovascular condition.")),
        (p["seizure"] & (e["no_seizure"] | _flagged(e, "seizure|epilep|brain stimulation")), F.lit("I have had seizures.")),
        (~p["mri_safe"] & (e["mri_safe"] | _flagged(e, "MRI|magnet|implanted medical device")), F.lit("An MRI is not safe for me.")), (~p["right_handed"] & e["right_handed"], F.lit("I am not right-handed.")),
        (~p["fasting"] & e["fasting"], F.lit("I would rather not fast.")),
        (p["sex"] != e["sex"], F.when(p["sex"] == "other", F.concat(F.lit("The listing takes "), e["sex"], F.lit(" participants only; please decide whether I fit."))).otherwise(F.concat(F.lit("I am "), p["sex"], F.lit(" and the listing takes "), e["sex"], F.lit(" participants only.")))),
        (p["student"] & _flagged(e, "non-students only"), F.lit("I am a student here, and the listing asks for others.")),
    ]
    return F.array_compact(F.array(*[F.when(_yes(c), t) for c, t in said]))


def recruiting_question(expires: Column, is_expired: Column, staleness: Column) -> Column:
    day = F.date_format(expires, "yyyy-MM-dd")
    ended = F.concat(F.lit("Is this study still open? Its listing gives "), day, F.lit(" as the end of recruitment."))
    return F.when(_yes(is_expired) & day.isNotNull(), ended).when(staleness == "stale", "Is this study still open? Its listing is old and does not say.").otherwise("Is this study still open? Its listing does not say.")


def inquiry(study: dict[str, Column], p: Column, who: str) -> Column:
    """struct(subject, body, href, disclosures, is_long).  study: title, irb_number, url, contact_name, contact_email, expires, is_expired, staleness, eligibility."""
    e, irb = study["eligibility"], F.nullif(F.trim(study["irb_number"]), F.lit(""))
    title = F.trim(F.regexp_replace(study["title"], r"(?U)\s+", " "))
    mark = F.when(irb.isNotNull(), F.concat(F.lit(" ("), irb, F.lit(")"))).otherwise("")
    subject = F.concat(F.lit("Interest in taking part - "), short_title(title), mark)
    listed = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head + "\n- "), F.array_join(xs, "\n- ")))
    yes, but = confirmations(e, p), disclosures(e, p)
    condition = F.when(e["condition"].isNotNull(), F.concat(F.lit("The study is for people with "), e["condition"], F.lit(". How do you confirm that?")))
    body = F.concat_ws(
        "\n\n", greeting(study["contact_name"]), F.concat(F.lit(f'I am {who} and would like to take part in "'), title, F.lit('"'), mark, F.lit(".")),
        recruiting_question(study["expires"], study["is_expired"], study["staleness"]), listed("By the listed criteria:", yes), listed("Before you screen me, you should know:", but), condition,
        F.lit("What would be the next step?"), F.concat(F.lit("Listing: "), study["url"]), F.lit("Thank you,\n[name]\n[how to reach me]"),
    )
    to = F.coalesce(F.trim(study["contact_email"]), F.lit(""))
    href = F.concat(F.lit("mailto:"), to, F.lit("?subject="), url_component(subject), F.lit("&body="), url_component(body))
    return F.struct(subject.alias("subject"), body.alias("body"), href.alias("href"), but.alias("disclosures"), (F.length(href) > LINK).alias("is_long"))
