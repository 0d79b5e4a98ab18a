"""Term identifiers: comparison forms, namespaces, short forms, compact and full forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def local_part(iri: Column) -> Column:
    """What follows the last slash or hash."""
    return F.substring_index(F.translate(iri, "#", "/"), "/", -1)


def forms_of(given: str) -> set[str]:
    """comparison_forms of an id or IRI that a caller names."""
    low = given.lower()
    local = low.replace("#", "/").rpartition("/")[2]
    return {low, local} if low.startswith(("http://", "https://")) and ("_" in local or ":" in local) else {low}


def is_one_of(term_id: Column, iri: Column, forms: list[str]) -> Column:
    """Whether any comparison form of a term is among the forms."""
    local = local_part(iri)
    bears = F.contains(local, F.lit("_")) | F.contains(local, F.lit(":"))
    hit = lambda c: F.coalesce(F.lower(c).isin(forms), F.lit(False))
    return hit(term_id) | hit(iri) | (F.coalesce(bears, F.lit(False)) & hit(local))


def comparison_forms(term_id: Column, iri: Column) -> Column:
    """Small-letter forms under which a term may be named: id, IRI, and the IRI's local part if that bears a prefix."""
    local = local_part(iri)
    return F.array_compact(
        F.array(
            F.when(~blank(term_id), F.lower(term_id)),
            F.when(~blank(iri), F.lower(iri)),
            F.when(~blank(iri) & local.rlike("[_:]"), F.lower(local)),
        )
    )


def prefix_of(id_or_iri: Column) -> Column:
    """The namespace of an id or IRI in small letters: before the first colon, else before the first underscore; null if there is none."""
    full = F.startswith(id_or_iri, F.lit("http://")) | F.startswith(id_or_iri, F.lit("https://"))
    local = F.when(full, local_part(id_or_iri)).otherwise(id_or_iri)
    before = lambda mark: F.when(F.instr(local, mark) > 1, F.substring_index(local, mark, 1))
    return F.lower(F.when(~blank(id_or_iri), F.coalesce(before(":"), before("_"))))


def target_of(ontology: Column, term_id: Column, targets: list[str]) -> Column:
    """The target ontology that a term counts for: its id's namespace first, then the ontology that holds it; null if neither is a target."""
    low = [t.lower() for t in targets]
    if not low:
        return F.lit(None).cast("string")
    space = prefix_of(term_id)
    return F.when(space.isin(low), space).when(F.lower(ontology).isin(low), F.lower(ontology))


def in_namespaces(term_id: Column, names: list[str]) -> Column:
    """A term without a prefix counts as a member."""
    space = prefix_of(term_id)
    return space.isNull() | space.isin([n.lower() for n in names])


def memberships(ontology: Column, term_id: Column) -> Column:
    """The ontology that holds a term and the namespace of its id."""
    return F.array_distinct(F.array_compact(F.array(F.lower(ontology), prefix_of(term_id))))


def normal_prefix(prefix: Column) -> Column:
    """How registry prefixes compare: small letters without dots, dashes, underscores and slashes."""
    return F.translate(F.lower(prefix), ".-_/", "")


def compact(term_id: Column) -> Column:
    """A short form with its first underscore as a colon."""
    return F.regexp_replace(term_id, r"\A([^_]+)_", "$1:")
