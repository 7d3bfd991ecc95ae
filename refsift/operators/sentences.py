"""Results explained to people: reasons, kept as codes, as English sentences with the counts and records behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each code of a decision says. {misses} and {unmatched} stand for the counts of sources.
SENTENCES = {
    "nothing_to_search": "The entry has neither a title nor a DOI nor an arXiv identifier.",
    "identifier_of_another_record": "The identifier belongs to another work, but title and authors lead to a record that may be the one meant.",
    "identifier_and_title_match_with_differences": "Identifier and title are those of a real work, but fields differ.",
    "identifier_and_title_match": "Identifier, title and authors are those of a real work.",
    "identifier_of_another_title": "The identifier belongs to a work of another title, but a search by title found a record that may be the one meant.",
    "identifier_with_another_version_of_the_title": "The identifier is that of a real work, whose title may be worded differently in another version.",
    "identifier_contradicts_title": "The work under this identifier has a clearly different title, and no search by title and authors found the entry.",
    "identifier_with_similar_title": "The work under this identifier has a title that is similar only in part: not enough to tell whether it is the same.",
    "identifier_match_with_differences": "The identifier is that of a real work, but fields differ.",
    "identifier_match": "Identifier, title, authors, year and what is known of the publication agree.",
    "found_by_title_not_by_identifier": "A search by title found the work, but the entry's identifier doesn't lead to it.",
    "identifier_lookup_gave_other_records": "Looking up the identifier gave records, but none that fits the entry.",
    "identifier_not_confirmed": "The entry's identifier could not be matched with a reliable record.",
    "page_found_with_differences": "A reliable web page was found, but fields differ.",
    "page_found": "Title, authors and year are those of a real web page.",
    "found_by_title_with_differences": "A reliable record was found, but fields differ.",
    "found_by_title": "Title, authors, year and what is known of the publication agree.",
    "missing_from_official_source": "Official sources for this venue ({misses}) hold no reliable match within what they cover.",
    "missing_from_all_sources": "Of the independent scholarly sources that answered, {unmatched} have no reliable match for the title.",
    "not_enough_evidence": "What was found neither confirms nor refutes the entry: no record matches both title and authors reliably.",
}
#: Codes after which differences are told, and said to be none if there are none.
WITH_DIFFERENCES = (
    "identifier_of_another_record",
    "identifier_and_title_match_with_differences",
    "identifier_of_another_title",
    "identifier_with_another_version_of_the_title",
    "identifier_contradicts_title",
    "identifier_with_similar_title",
    "identifier_match_with_differences",
    "found_by_title_not_by_identifier",
    "identifier_lookup_gave_other_records",
    "identifier_not_confirmed",
    "page_found_with_differences",
    "found_by_title_with_differences",
)
NO_DIFFERENCE = "No clear difference in the fields that can be compared."


def sentences(reasons: Column, misses: Column, unmatched: Column, other_record: Column) -> Column:
    """Sentences for a result's reasons: the code's own, then what differs, then the record of the other work, if one is named. A code
    without a sentence stays as it is; without reasons there are none."""
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    code, more = F.get(reasons, F.lit(0)), F.slice(reasons, 2, F.greatest(F.size(reasons) - 1, F.lit(0)))
    text = F.coalesce(F.try_element_at(table, code), code)
    for name, count in (("{misses}", misses), ("{unmatched}", unmatched)):
        text = F.replace(text, F.lit(name), F.coalesce(count, F.lit(0)).cast("string"))
    none = F.array().cast("array<string>")
    said = F.when(code.isin(*WITH_DIFFERENCES), F.when(F.size(more) > 0, more).otherwise(F.array(F.lit(NO_DIFFERENCE)))).otherwise(more)
    led = F.when(code == "identifier_of_another_record", "Record under the identifier: ").otherwise("Record that may be meant: ")
    other = F.when(other_record.isNotNull(), F.array(F.concat(led, other_record))).otherwise(none)
    return F.when(code.isNotNull(), F.concat(F.array(text), said, other)).otherwise(none)


def explained(results: DataFrame) -> DataFrame:
    """Results of a check with `sentences` beside their codes."""
    return results.withColumn("sentences", sentences(F.col("reasons"), F.col("authoritative_misses"), F.col("no_match_sources"), F.col("other_record")))
