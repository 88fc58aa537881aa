"""Values that a repository sets for itself; every operator takes them from a Policy."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that the results depend on, in the form the operators use.
ORCID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"
DOI = r"10\.\d{4,9}/[^\s\"'<>]+"
ROR = r"(?i)ror\.org/(0[a-hj-km-np-tv-z0-9]{6}\d{2})"
NUMBER = r"\d+(?:[.,]\d+)?"
PUBLICATION_YEAR = r"(?i)publi[\p{L}\p{N}_]*[^.\n]{0,80}?\b((?:19|20)\d{2})\b"
ADDITIONAL_INFORMATION = "Additional information"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
TITLE_CODE = r"\(([^()]{2,40})\)\s*\.?\s*$"
ACADEMIC_TITLE = r"(?i)\b(?:prof|dr|pd|phd|ph\.d|dipl|ing|rer|nat|med|phil|habil|m\.sc|b\.sc|msc|bsc)\.?(?:-[\p{L}\p{N}_]+\.?)?(?=\s|$)"
SCRIPT_TAG = r"</?su[bp]>"
PLACEHOLDER = "???"
SHINGLE, LEAST_COPIED, ROLE_WINDOW = 4, 0.8, 80
LEAST_MATCH, UNCERTAIN_MARGIN, EXHAUSTIVE = 0.01, 0.1, 8
PROMPT_CHARS, STYLE_EXAMPLES, OTHER_CHARS = 30000, 4, 60
#: Chunks of a growing answer between two looks at it.
LOOP_EVERY = 32
LOOP_TAIL, LOOP_BLANK, LOOP_PERIODS, LOOP_CHARS, LOOP_SHOWN = 2000, 300, (8, 400), 400, 70
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_NUMBERS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3, "mai": 5, "okt": 10, "dez": 12}
#: First pattern found in the lower-cased role gives its type.
ROLE_TYPES = (
    (r"data\s*curat", "DataCurator"),
    (r"data\s*manag", "DataManager"),
    (r"data\s*collect|measur|operator", "DataCollector"),
    (r"produc|prepar|synthe|fabricat", "Producer"),
    (r"project\s*lead", "ProjectLeader"),
    (r"project\s*manag", "ProjectManager"),
    (r"project\s*member", "ProjectMember"),
    (r"work\s*package", "WorkPackageLeader"),
    (r"lead|supervis|\bpi\b|principal|head|owner|contact|correspond|responsible", "ContactPerson"),
    (r"editor", "Editor"),
    (r"sponsor|fund", "Sponsor"),
    (r"rights?\s*holder", "RightsHolder"),
    (r"research|scientist|technician|student|postdoc", "Researcher"),
)
SUBSCRIPTS, SUPERSCRIPTS, SCRIPTED = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "0123456789+-=()"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@dataclass(frozen=True)
class Policy:
    """Repository settings; the defaults fit the test data."""

    publisher: dict = field(default_factory=lambda: {"name": "Invented Sample Repository", "publisherIdentifier": "https://ror.org/0zz00zz00", "publisherIdentifierScheme": "ROR", "schemeURI": "https://ror.org/"})
    schema_version: str = "http://datacite.org/schema/kernel-4"
    resource_type_general: str = "PhysicalObject"
    resource_type: str = "Material sample"
    language: str = "en"
    text_language: str = "en-US"
    today_year: int = 2026
    curator: dict | None = None
