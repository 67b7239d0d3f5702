"""The category dimension and its detection patterns."""

from __future__ import annotations

# Categories in order, each with description, placeholder and patterns (matched without regard to case).
CATEGORIES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("DATE", "Specific dates", "{{DATE}}", (
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
        r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
        r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
        r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b",
        r"\b(?:Q[1-4]|H[1-2])\s+\d{4}\b",
        r"\b\d{1,2}(?:st|nd|rd|th)\s+(?:of\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
    )),
    ("CURRENCY", "Currency amounts", "{{CURRENCY_AMOUNT}}", (
        r"[$£€¥]\s*[\d,]+(?:\.\d{1,2})?(?:\s*[KMBkmb](?:illion)?)?",
        r"(?:USD|GBP|EUR|JPY|CHF|AUD|CAD)\s*[\d,]+(?:\.\d{1,2})?",
        r"[\d,]+(?:\.\d{1,2})?\s*(?:USD|GBP|EUR|pounds?|dollars?|euros?)",
        r"£[\d,]+(?:\.\d{1,2})?(?:\s*(?:million|billion|thousand|[KMBkmb]))?",
        r"\$[\d,]+(?:\.\d{1,2})?(?:\s*(?:million|billion|thousand|[KMBkmb]))?",
        r"€[\d,]+(?:\.\d{1,2})?(?:\s*(?:million|billion|thousand|[KMBkmb]))?",
        r"[\d,]+(?:\.\d{1,2})?\s*(?:p\.a\.|per annum|annually|/month|per month)",
    )),
    ("CUSTOMER_NAME", "Customer names", "{{CUSTOMER_NAME}}", (r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",)),
    ("PERCENTAGE", "Specific percentages", "{{PERCENTAGE}}", (r"\d+\.?\d*\s*%", r"\d+\.?\d*\s*percent", r"\d+\.?\d*\s*per\s*cent")),
    ("CLIENT_PARAGRAPH", "Whole paragraphs about a client", "{{CLIENT_PARAGRAPH}}", ()),
    ("CLIENT_GOAL", "Goals of a client", "{{CLIENT_GOAL}}", ()),
    ("CLIENT_INSIGHT", "Observations about a client", "{{CLIENT_INSIGHT}}", ()),
    ("CLIENT_ADVICE", "Advice for a client", "{{CLIENT_ADVICE}}", ()),
    ("INVESTMENT_DETAIL", "Holdings and funds", "{{INVESTMENT_DETAIL}}", ()),
    ("ALLOCATION", "Allocations and budget items", "{{ALLOCATION}}", ()),
    ("RISK_STATEMENT", "Risk warnings for a client", "{{RISK_STATEMENT}}", ()),
    ("MEETING_SUMMARY", "Notes of meetings", "{{MEETING_SUMMARY}}", ()),
    ("ADDRESS", "Addresses", "{{ADDRESS}}", ()),
    ("PHONE", "Phone numbers", "{{PHONE_NUMBER}}", (r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",)),
    ("EMAIL", "Email addresses", "{{EMAIL}}", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",)),
    ("ACCOUNT_NUMBER", "Account numbers", "{{ACCOUNT_NUMBER}}", ()),
)

#: (category, placeholder, pattern) in order of detection.
PATTERNS = tuple((c, p, x) for c, _, p, xs in CATEGORIES for x in xs)

# Token budgets by chunk size, and what a prompt takes of them.
CHUNK_TOKENS = {"small": 1024, "medium": 2048, "max": 4096}
PROMPT_TOKENS = 1500
