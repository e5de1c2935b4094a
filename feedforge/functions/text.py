"""Tokens and text fields for lexical retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English and Danish stop words.
STOPWORDS = sorted(
    set(
        """
a an and are as at be been but by can
did do does for from had has have he her
his i if in into is it its me my no
not of on one or our out s she so some
t than that the their them then there these
they this those to up us was we were what
when where which who will with you your
alle at blevet bliver da de dem den denne
der derefter det dig din dine disse do dog
du efter eller en end er et få for fra
ham han hans har havde have hende hendes
her hun hvis i ikke ind jeg jer jeres
kan kun lige man mange med meget men mere
mig min mine mit mod når ned noget nogle
nu ny og op over på selv sig sin sine
sit skal skulle som så sådan til under være
været ved vi vil ville vor vores øv år
""".split()
    )
)

TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column, remove_stopwords: bool = True) -> Column:
    """Lower-cased runs of letters, digits and underscores; stop words and single characters go on request."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), F.lower)
    if not remove_stopwords:
        return found
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))


def corpus_text(title: Column, abstract: Column, field: str = "title_abstract") -> Column:
    """The indexed text: title, abstract, or both with a space."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return {"title": t, "abstract": a}.get(field, F.concat(t, F.lit(" "), a))


def word_count(c: Column) -> Column:
    """Parts between single spaces; 0 for empty and null."""
    return F.when(c != "", F.size(F.split(c, " "))).otherwise(0)


def two_format_time(c: Column) -> Column:
    """A time with or without seconds; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(c, F.lit("M/d/yyyy h:mm a")))


def impression_tokens(c: Column) -> Column:
    """Structs (id, label) from `id-label` tokens; the last hyphen parts them. A malformed token raises."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    pattern = F.lit(r"^(.*)-([^-]*)$")
    return F.transform(
        parts,
        lambda x: F.when(
            x.rlike(r"^.+-[01]$"), F.struct(F.regexp_extract(x, r"^(.*)-([^-]*)$", 1).alias("id"), F.regexp_extract(x, r"^(.*)-([^-]*)$", 2).cast("int").alias("label"))
        ).otherwise(F.raise_error(F.concat(F.lit("malformed impression: "), x, F.lit(" "), pattern)).cast("struct<id:string,label:int>")),
    )


def words_or_empty(c: Column) -> Column:
    """Parts between white space; null and blank give an empty list."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


_ENTITY = "array<struct<WikidataId:string,SurfaceForms:array<string>>>"


def entity_forms(title_json: Column, abstract_json: Column) -> Column:
    """Surface forms of the title's entities, then the abstract's, as one list of lists; invalid JSON has none."""
    forms = lambda j: F.coalesce(F.transform(F.from_json(j, _ENTITY), lambda e: F.coalesce(e["SurfaceForms"], F.array().cast("array<string>"))), F.array().cast("array<array<string>>"))
    return F.flatten(F.concat(forms(title_json), forms(abstract_json)))


def entity_ids(title_json: Column, abstract_json: Column) -> Column:
    """Ids of the title's entities, then the abstract's; empty ones go, repeats stay."""
    ids = lambda j: F.coalesce(F.transform(F.from_json(j, _ENTITY), lambda e: e["WikidataId"]), F.array().cast("array<string>"))
    return F.filter(F.concat(ids(title_json), ids(abstract_json)), lambda x: x.isNotNull() & (x != ""))
