"""Base addresses of a catalogue, kept in one place so that a library can put in its own.

The defaults are neutral. Pass another ``Namespaces`` to every plan that makes or reads URIs.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Namespaces:
    resource: str = "https://example.org/resources/"
    person: str = "https://example.org/persons/"
    heading: str = "http://example.org/headings/"
    subject: str = "http://example.org/subjects#n"
    spatial: str = "https://example.org/spatial#n"
    field: str = "https://example.org/fields/n"
    item: str = "http://example.org/items/"
    organisation: str = "http://example.org/organisations/"
    collection: str = "https://example.org/collections#"
    host_catalogue: str = "http://example.org/host?id="
    resource_context: str = "http://example.org/resources/context.jsonld"
    person_context: str = "http://example.org/persons/context.jsonld"
    # Public authority file and public vocabularies.
    authority: str = "https://d-nb.info/gnd/"
    authority_source: str = "https://d-nb.info/gnd/7749153-1"
    authority_label: str = "Gemeinsame Normdatei (GND)"
    gender: str = "https://d-nb.info/standards/vocab/gnd/gender#"
    subject_category: str = "https://d-nb.info/standards/vocab/gnd/gnd-sc.html#"
    relator: str = "http://id.loc.gov/vocabulary/relators/"
    language: str = "http://id.loc.gov/vocabulary/iso639-2/"
    frequency: str = "http://marc21rdf.info/terms/continuingfre#"
    publication_status: str = "http://id.loc.gov/vocabulary/mstatus/"
    # Labels of the local vocabularies.
    heading_label: str = "Sachsystematik"
    subject_label: str = "Systematik"
    spatial_label: str = "Raumsystematik"
