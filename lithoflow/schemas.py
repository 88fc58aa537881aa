"""Schemas of the relations and the vocabularies of the record model."""

from __future__ import annotations

_PERSON = "name STRING, nameType STRING, givenName STRING, familyName STRING"
_IDS = "nameIdentifiers: ARRAY<STRUCT<nameIdentifier: STRING, nameIdentifierScheme: STRING, schemeURI: STRING>>"
_AFFILIATION = "affiliation: ARRAY<STRUCT<name: STRING, affiliationIdentifier: STRING, affiliationIdentifierScheme: STRING, schemeURI: STRING>>"
SUBJECT = "STRUCT<subject: STRING, lang: STRING, subjectScheme: STRING, schemeURI: STRING, valueURI: STRING>"
DATE = "STRUCT<date: STRING, dateType: STRING, dateInformation: STRING>"
RELATED = "STRUCT<relatedIdentifier: STRING, relatedIdentifierType: STRING, relationType: STRING, resourceTypeGeneral: STRING>"
EXTRACTED_PERSON = f"STRUCT<name: STRING, givenName: STRING, familyName: STRING, role: STRING, {_IDS}, affiliation: ARRAY<STRUCT<name: STRING>>>"
SAMPLE = f"STRUCT<sampleCode: STRING, givenTitle: STRING, givenDescription: STRING, facts: ARRAY<STRING>, subjects: ARRAY<{SUBJECT}>, dates: ARRAY<{DATE}>, relatedIdentifiers: ARRAY<{RELATED}>>"
SHARED = f"STRUCT<creators: ARRAY<{EXTRACTED_PERSON}>, preparation: STRING, subjects: ARRAY<{SUBJECT}>, dates: ARRAY<{DATE}>, relatedIdentifiers: ARRAY<{RELATED}>>"
#: A model's first answer; missing keys become null.
EXTRACTION = f"STRUCT<shared: {SHARED}, samples: ARRAY<{SAMPLE}>>"
#: A model's second answer for one sample.
SAMPLE_TEXT = "STRUCT<title: STRING, abstract: STRING, keywords: ARRAY<STRING>, issues: ARRAY<STRING>>"
PERSON = f"STRUCT<{_PERSON.replace(' STRING', ': STRING')}, {_IDS}, {_AFFILIATION}>"
CONTRIBUTOR = f"STRUCT<{_PERSON.replace(' STRING', ': STRING')}, {_IDS}, {_AFFILIATION}, contributorType: STRING>"
PUBLISHER = "STRUCT<name: STRING, publisherIdentifier: STRING, publisherIdentifierScheme: STRING, schemeURI: STRING>"
RECORD = f"STRUCT<doi: STRING, url: STRING, creators: ARRAY<{PERSON}>, titles: ARRAY<STRUCT<title: STRING, titleType: STRING, lang: STRING>>, publisher: {PUBLISHER}, publicationYear: STRING, types: STRUCT<resourceTypeGeneral: STRING, resourceType: STRING>, schemaVersion: STRING, contributors: ARRAY<{CONTRIBUTOR}>, dates: ARRAY<{DATE}>, language: STRING, descriptions: ARRAY<STRUCT<description: STRING, descriptionType: STRING, lang: STRING>>, subjects: ARRAY<{SUBJECT}>, relatedIdentifiers: ARRAY<{RELATED}>>"
FINDINGS = "doc_id BIGINT, sample_idx INT, severity STRING, kind STRING, path STRING, value STRING, message STRING"
CHANGES = "doc_id BIGINT, stage STRING, seq INT, message STRING"
WORD_BOXES = "doc_id BIGINT, page INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, size DOUBLE, kind STRING"

# Vocabularies of the record model (fixed values).
NAME_TYPES = "Organizational Personal".split()
TITLE_TYPES = "AlternativeTitle Subtitle TranslatedTitle Other".split()
DESCRIPTION_TYPES = "Abstract Methods SeriesInformation TableOfContents TechnicalInfo Other".split()
RESOURCE_TYPES = "PhysicalObject Audiovisual Book BookChapter Collection ComputationalNotebook ConferencePaper ConferenceProceeding DataPaper Dataset Dissertation Event Image InteractiveResource Journal JournalArticle Model OutputManagementPlan PeerReview Preprint Report Service Software Sound Standard Text Workflow Other".split()
CONTRIBUTOR_TYPES = "ContactPerson DataCollector DataCurator DataManager Distributor Editor HostingInstitution Producer ProjectLeader ProjectManager ProjectMember RegistrationAgency RegistrationAuthority RelatedPerson Researcher ResearchGroup RightsHolder Sponsor Supervisor WorkPackageLeader Other".split()
DATE_TYPES = "Accepted Available Copyrighted Collected Created Issued Submitted Updated Valid Withdrawn Other".split()
RELATED_IDENTIFIER_TYPES = "ARK ArXiv Bibcode DOI EAN13 EISSN Handle IGSN ISBN ISSN ISTC LCCN PURL UPC URL URN w3id".split()
RELATION_TYPES = "IsCitedBy Cites IsSupplementTo IsSupplementedBy IsContinuedBy Continues IsDescribedBy Describes HasMetadata IsMetadataFor HasVersion IsVersionOf IsNewVersionOf IsPreviousVersionOf IsPartOf HasPart IsReferencedBy References IsDocumentedBy Documents IsCompiledBy Compiles IsVariantFormOf IsOriginalFormOf IsIdenticalTo IsDerivedFrom IsSourceOf IsObsoletedBy Obsoletes".split()

