"""The four mortgage page types.  All names, phrases and patterns are fixed values that pages print."""

from __future__ import annotations

from foliate.plans.policy import CardRules, OrderRules, Policy, Signal, Spec, Subtype, Vendor

NORMATIVE, DOMAIN, VENDOR = "normative", "domain", "vendor"


def _any(id: str, layer: str, *phrases: str, least: int = 1, exempt: bool = False) -> Signal:
    return Signal(id, Spec(phrases, least), layer, exempt)


def _all(id: str, layer: str, *phrases: str, exempt: bool = False) -> Signal:
    return Signal(id, Spec(require_all=phrases), layer, exempt)


def _groups(id: str, layer: str, *groups: tuple[str, ...]) -> Signal:
    return Signal(id, Spec(require_all_any=groups), layer)


def _pattern(id: str, layer: str, *patterns: str) -> Signal:
    return Signal(id, Spec(patterns=patterns), layer)


# Phrases and patterns of the page types.
MONTH_DATE = r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}, \d{4}\b"
SLASH_DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
PAGE_OF = r"page\s+(\d{1,3})\s+of\s+(\d{1,3})"
LOOSE_PAGE_OF = r"(?:page\s*)?(\d{1,3})\s+of\s+(\d{1,3})"
XACTUS = Spec(("XACTUS", "370 Reed Rd., Suite 100 Broomall, PA 19008", "370 REED RD., SUITE 100, BROOMALL, PA 19008"))

CREDIT = Policy(
    "CREDIT_REPORT",
    decisive=(_all("U-D1", DOMAIN, "Equifax", "Experian", "TransUnion"),),
    supportive=(
        _any("U-S1", NORMATIVE, "Notice to Home Loan Applicant", "Consumer Financial Protection Bureau", "THE REPORTING BUREAU CERTIFIES THAT"),
        _any("U-S2", DOMAIN, "FICO", "Credit Score", "Credit Report", "Credit Summary"),
        _groups("U-S3", DOMAIN, ("Trended Data",), ("Scheduled", "Actual")),
        # anchored at the start: the same pages match, and a page without the words costs one pass, not one for each position
        _pattern("U-S4", DOMAIN, r"\A(?=.*\btuc\b)(?=.*\bexp\b)(?=.*\beqx\b)"),
    ),
    vendors=(
        Vendor(
            "xactus",
            XACTUS,
            decisive=(
                _any(
                    "X-D1", VENDOR, "Manner of Payment", "Months Reviewed", "30-59 Days Late", "60-89 Days Late", "90-119 Days Late", "120-149 Days Late", "150+ Days Late",
                    "ECOA", "High Credit", "Credit Limit", "Past Due", "Reported On", "Last Activity", "Account Type", "Collateral", least=3,
                ),
            ),
            supportive=(_any("X-S1", VENDOR, "Report ID:"), _any("X-S2", VENDOR, "Repositories:"), _any("X-S3", VENDOR, "Order Verifications", "Requested By:")),
            subtypes=(
                Subtype("score_disclosure", Spec(("Credit Score Disclosure",))),
                Subtype("consumer_letter", Spec(("Dear Consumer:",))),
                Subtype("order_summary", Spec(("Client Name:",), absent=("Employment Record Available", "Manner of Payment", "Notice to Home Loan Applicant"))),
                Subtype("main_report", via="X-D1", fallback=True),
            ),
        ),
    ),
    cards=CardRules(
        ids={"report_id": r"\b\d{8}\b", "loan_number": r"\b\d{9}\b", "client_code": r"\b[a-z]{2,5}\d{4,6}\b"},
        dates=(SLASH_DATE, MONTH_DATE),
        marker=LOOSE_PAGE_OF,
        name_anchor="Applicant",
    ),
    order=OrderRules(subtypes=("main_report", "score_disclosure", "consumer_letter", "order_summary")),
)

INCOME = Policy(
    "INCOME_DOC",
    decisive=(
        _groups("I-D1", NORMATIVE, ("This Product Contains Sensitive Taxpayer Data",), ("Internal Revenue Service", "United States Department of the Treasury")),
        _any("I-D2", NORMATIVE, "Wage and Income Transcript", "Tax Return Transcript", "Tax Account Transcript", "Record of Account Transcript", "Verification of Non-filing Letter"),
    ),
    supportive=(
        _any("I-S1", NORMATIVE, "This Product Contains Sensitive Taxpayer Data"),
        _any("I-S2", NORMATIVE, "Request Date:", "Response Date:", "Tracking Number:", "Tax Period Requested:", "Tax Period Ending:", "TIN Provided:", "SSN Provided:", "Customer File Number:", least=2),
        _any("I-S3", DOMAIN, "Wages, Tips and Other Compensation", "Federal Income Tax Withheld", "Medicare Wages", "Social Security Wages", "Employer Identification Number", "Form W-2 Wage and Tax Statement", least=3),
        _any("I-S4", DOMAIN, "Profit and Loss", "Net Income", "Gross Receipts", "Total Expenses", "Year to Date", least=2),
        _any("I-S5", NORMATIVE, "OMB No. 1545-0029", "OMB No. 1545-0074", "OMB No. 1545-0115", "OMB No. 1545-0116", "U.S. Individual Income Tax Return", "IVES Request for Transcript of Tax Return"),
    ),
    vendors=(
        Vendor(
            "xactus",
            XACTUS,
            decisive=(_groups("X-EV1", VENDOR, ("Record Available:", "Employment Record Available:"), ("Borrower:", "Co-Borrower:", "Client Name:")),),
            subtypes=(Subtype("employment_verification", via="X-EV1"),),
        ),
    ),
    cards=CardRules(
        ids={"order_token": r"\b(?=[a-z0-9]{10}\b)(?=[a-z0-9]*\d)(?=[a-z0-9]*[a-z])[a-z0-9]{10}\b", "masked_ssn": r"\bxxx-xx-\d{4}\b", "masked_ein": r"\bxx-xxx\d{4}\b", "numeric_id": r"\b\d{8,10}\b"},
        dates=(r"\b\d{2}-\d{2}-\d{4}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
        marker=PAGE_OF,
        section_signals=("I-S2", "I-S3"),
    ),
)

TITLE = Policy(
    "TITLE_REPORT",
    supportive=(
        _any("T-S1", DOMAIN, "Title Insurance", "Schedule A", "Schedule B", "estate or interest", "vested in", "easement", "Deed of Trust", "Legal Description", "Exceptions", "Requirements", least=3),
        _any("T-S2", DOMAIN, "PRELIMINARY REPORT", "Commitment for Title Insurance"),
    ),
    vendors=(
        Vendor(
            "first_american",
            Spec(("First American Title",), patterns=(r"\b[a-z]+(?: [a-z]+)* - 2021 v\.",)),
            decisive=(
                _all("FA-D1", NORMATIVE, "This page is only a part of a 2021 ALTA Commitment for Title Insurance issued by", "This Commitment is not valid without the Notice", exempt=True),
                _any("FA-D2", NORMATIVE, "Copyright 2021 American Land Title Association. All rights reserved.", "Reprinted under license from the American Land Title Association.", exempt=True),
            ),
            supportive=(
                _any("FA-S1", NORMATIVE, "Issuing Agent:", "Commitment Number:", "Issuing Office File Number:", "Loan ID Number:", "Revision Number:", "lssuing Office:", "Issuing Office:"),
                _any("FA-S2", NORMATIVE, "All of the following Requirements must be met:", "Pay the agreed amount for the estate or interest to be insured.", "Pay the premiums, fees, and charges for the Policy to the Company."),
            ),
            subtypes=(
                Subtype("schedule_a", Spec(require_all=("Commitment Number:", "Schedule A"))),
                Subtype("legal_description", Spec(("LEGAL DESCRIPTION",))),
                Subtype("schedule_b1", Spec(require_all=("SCHEDULE B, PART I", "All of the following Requirements must be met:"))),
                Subtype("schedule_b2", Spec(require_all=("SCHEDULE B, PART II", "Some historical land records contain Discriminatory Covenants"))),
                Subtype("conditions", Spec(require_all=("COMMITMENT CONDITIONS", "DEFINITIONS"))),
            ),
        ),
        Vendor(
            "fidelity",
            Spec(("Fidelity National Title", "CA-FT-")),
            decisive=(
                _any(
                    "FD-D1",
                    VENDOR,
                    "It is important to note that this preliminary report is not a written representation as to the condition of title and may not list all liens, defects, and encumbrances affecting title to the land.",
                    "The exceptions and exclusions are meant to provide you with notice of matters which are not covered under the terms of the title insurance policy and should be carefully considered.",
                    "This report (and any supplements or amendments hereto) is issued solely for the purpose of facilitating the issuance of a policy of title insurance and no liability is assumed hereby.",
                ),
            ),
            supportive=(
                _any("FD-S1", VENDOR, "CLTA Preliminary Report Form"),
                _any("FD-S2", VENDOR, "PRELIM NO.", "AMENDMENT"),
                _any(
                    "FD-S3",
                    VENDOR,
                    "hereby reports that it is prepared to issue, or cause to be issued",
                    "Title to said estate or interest at the date hereof is vested in:",
                    "The estate or interest in the Land hereinafter described or referred to covered by this Report is:",
                ),
            ),
            subtypes=(Subtype("cover", via="FD-D1"), Subtype("exhibit", Spec(("EXHIBIT A",))), Subtype("body", via="FD-S1", fallback=True)),
        ),
    ),
    cards=CardRules(
        ids={"hyphen_id": r"\b\d{3,5}-\d{6,8}\b", "dotted_id": r"\b\d{4,6}\.\d{5,7}\b", "numeric_id": r"\b\d{6,10}\b", "suffixed_id": r"\b\d{4,8}[a-z]{2}\b", "form_code": r"form \d{6,9} \(\d{1,2}-\d{1,2}-\d{2,4}\)"},
        dates=(SLASH_DATE, MONTH_DATE, r"printed: *\d{2}\.\d{2}\.\d{2} @ \d{1,2}:\d{2} [ap]m"),
        marker=PAGE_OF,
        bare_marker=r"page\s+(\d{1,3})(?!\s*of\b)",
        section_signals=("T-S1", "T-S2"),
    ),
    order=OrderRules(per_vendor={"first_american": ("schedule_a", "legal_description", "schedule_b1", "schedule_b2", "conditions"), "fidelity": ("cover", "body", "exhibit")}, bare_markers=True),
)

URLA = Policy(
    "URLA_1003",
    decisive=(_any("D1", NORMATIVE, "Uniform Residential Loan Application"), _any("D2", NORMATIVE, "Freddie Mac Form 65 · Fannie Mae Form 1003")),
    supportive=(
        _pattern("S1", NORMATIVE, r"effective \d{1,2}/\d{4}"),
        _all("S2", NORMATIVE, "To be completed by the Lender:", "Lender Loan No./Universal Loan Identifier", "Agency Case No."),
        _any(
            "S3",
            NORMATIVE,
            "Section 1: Borrower Information",
            "Section 2: Financial Information — Assets and Liabilities",
            "Section 3: Financial Information — Real Estate",
            "Section 4: Loan and Property Information",
            "Section 5: Declarations",
            "Section 6: Acknowledgments and Agreements",
            "Section 6: Acknowledgements and Agreements",
            "Section 7: Military Service",
            "Section 8: Demographic Information",
            "Section 9: Loan Originator Information",
        ),
        _any("S4", NORMATIVE, "L1. Property and Loan Information", "L2. Title Information", "L3. Mortgage Loan Information", "L4. Qualifying the Borrower – Minimum Required Funds or Cash Back"),
        _any(
            "S5",
            NORMATIVE,
            "1a. Personal Information",
            "1b. Current Employment/Self-Employment and Income",
            "1e. Income from Other Sources",
            "2a. Assets – Bank Accounts, Retirement, and Other Accounts You Have",
            "2b. Other Assets and Credits You Have",
            "2c. Liabilities – Credit Cards, Other Debts, and Leases that You Owe",
            "2d. Other Liabilities and Expenses",
            "3a. Property You Own",
            "4a. Loan and Property Information",
            "4b. Other New Mortgage Loans on the Property You are Buying or Refinancing",
            "4c. Rental Income on the Property You Want to Purchase",
            "4d. Gifts or Grants You Have Been Given or Will Receive for this Loan",
            "5a. About this Property and Your Money for this Loan",
            "5b. About Your Finances",
        ),
    ),
    exclusions=(_any("scif", NORMATIVE, "Supplemental Consumer Information Form", "Form 1103"),),
    default_subtype="main",
    suffixes={"— Additional Borrower": "additional_borrower", "— Unmarried Addendum": "unmarried_addendum", "— Continuation Sheet": "continuation_sheet", "— Lender Loan Information": "lender_loan_information"},
    section_hints={"S3": "main", "S4": "lender_loan_information"},
    cards=CardRules(
        ids={"loan_number": r"\b\d{9}\b", "uli": r"\b[a-z0-9]{20,35}\b"},
        marker=LOOSE_PAGE_OF,
        name_anchor="Borrower Name",
        section_signals=("S3", "S4"),
        id_block_signal="S2",
        printed_codes=("GURLA20S", "GURLA20_S", "(POD)", "0718"),
    ),
    order=OrderRules(subtypes=("main", "additional_borrower", "unmarried_addendum", "continuation_sheet", "lender_loan_information"), rank_patterns=(r"section (\d)", r"l(\d)\.")),
)

POLICIES = (CREDIT, INCOME, TITLE, URLA)
