"""Templates of model prompts; ``<<name>>`` is replaced by the variable of that name."""

from __future__ import annotations

CLASSIFY = """You classify one page of a mortgage loan file whose type the rules could not settle.

Candidate types: <<candidate_types>>
Why the rules deferred: <<reason>>
Signals that the rules found, by type: <<signal_summary>>
Subtypes that are known: <<subtype_options>>

Judge by what the page is for, not by who sent it or what it is attached to. A form stays its own type inside another party's letter. A page that
only mentions a type is not of that type. Quote the words that decide. If nothing on the page decides, answer UNRESOLVED.

Page text:
<<page_text>>

Answer with JSON alone: {"type": "...", "subtype": "... or null", "evidence": ["..."]}
"""

CLASSIFY_IMAGE = """You see one scanned page (package <<package>>, page <<page>>) that has no text of its own. Give its type:
<<candidate_types>>

Judge by what the page is for. Copy what is printed, and do not guess what is not legible.

Answer with JSON alone: {"type": "...", "subtype": "... or null", "evidence": ["..."],
"extracted": {"page_marker": "as printed, such as Page 2 of 9, or null", "form_code": "or null", "vendor": "or null"}}
"""

_GROUP = """These cards are pages of one type (<<type>>) from one package. Pages of one document belong to one instance.

<<rules>>

A page that cannot be attributed stays unresolved rather than guessed. Every page is in one instance or unresolved, and in no two.

Cards: <<cards>>

Answer with JSON alone: {"instances": [{"instance_id": "...", "pages": [0], "related_to": "another instance_id or null", "evidence": ["..."]}], "unresolved_pages": [0]}
"""

_RULES = {
    "URLA_1003": "Loan identifiers and borrower names tell applications apart. Sections and addenda of one application are one instance, whatever borrower signs them.",
    "CREDIT_REPORT": "Report numbers, order dates and bureaus tell reports apart. Letters and disclosures that were printed with a report are of its instance.",
    "TITLE_REPORT": "File numbers and issuing companies tell commitments apart. A page number with its total occurs once in an instance; a repeated one begins another copy, which is related to the first.",
    "INCOME_DOC": "Taxpayer, form and tax year tell documents apart. Pages of one transcript request are one instance.",
}


def group(kind: str) -> str:
    """The grouping template of a type, with the place of its cards open."""
    return _GROUP.replace("<<type>>", kind).replace("<<rules>>", _RULES.get(kind, "Identifiers, dates and page numbers tell documents apart."))
