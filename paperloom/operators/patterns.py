"""Rule tables. All patterns, weights and word lists here are fixed values that results depend on."""

from __future__ import annotations

CLASSES = ["email", "form", "invoice", "receipt"]

#: Keyword classifier: (pattern, weight) by class, applied to lower-case text.
KEYWORDS = {
    "email": [
        (r"\b(from|to|cc|bcc)\s*:", 3),
        (r"\bsubject\s*:", 4),
        (r"\b(dear|hi|hello|regards|sincerely)\b", 2),
        (r"\b(re:|fw:|fwd:)", 3),
        (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", 4),
        (r"\b(meeting|schedule|discuss|attached|please)\b", 1),
    ],
    "form": [
        (r"\b(form|application|registration|enrollment)\b", 3),
        (r"\b(please\s*(fill|complete|check|sign))\b", 4),
        (r"\b(signature|date\s*of\s*birth|social\s*security)\b", 3),
        (r"\b(checkbox|check\s*one|mark\s*one)\b", 4),
        (r"\b(section\s*[a-z0-9]|part\s*[a-z0-9])\b", 2),
        (r"_{3,}|\[[\s]*\]", 3),
    ],
    "invoice": [
        (r"\binvoice\b", 5),
        (r"\binvoice\s*(no|number|#|id)\b", 5),
        (r"\b(bill\s*to|sold\s*to|ship\s*to)\b", 4),
        (r"\b(due\s*date|payment\s*terms|net\s*\d+)\b", 3),
        (r"\b(subtotal|total\s*amount|amount\s*due|balance\s*due)\b", 4),
        (r"\b(remit|payable)\b", 3),
        (r"\bpurchase\s*order\b", 2),
    ],
    "receipt": [
        (r"\b(receipt|cashier|store\s*#|transaction)\b", 4),
        (r"\b(subtotal|tax|total)\b", 2),
        (r"\b(visa|mastercard|cash|change|approved)\b", 4),
        (r"\b(thank\s*you\s*for\s*(shopping|your\s*purchase))\b", 5),
        (r"\b(qty|quantity)\b", 2),
        (r"\d{2}[:/]\d{2}[:/]\d{2,4}\s+\d{2}:\d{2}", 3),
    ],
}

#: Invoice signals: (name, pattern, weight), and the strong ones.
SIGNALS = [
    ("invoice_word", r"\binvoice\b", 3),
    ("invoice_number", r"\binvoice\s*(no|number|#|id)\b", 4),
    ("bill_to", r"\b(bill\s*to|billed\s*to)\b", 4),
    ("ship_to", r"\b(ship\s*to|sold\s*to)\b", 3),
    ("due_date", r"\b(due\s*date|payment\s*due)\b", 4),
    ("payment_terms", r"\b(payment\s*terms|net\s*\d+)\b", 3),
    ("amount_due", r"\b(amount\s*due|balance\s*due|total\s*due)\b", 4),
    ("purchase_order", r"\b(purchase\s*order|po\s*#|po\s*number)\b", 2),
    ("remit_to", r"\b(remit\s*to|make\s*payment)\b", 3),
    ("subtotal_total", r"\b(subtotal|tax|total)\b", 1),
]
STRONG_SIGNALS = ["invoice_word", "invoice_number", "bill_to", "due_date", "amount_due"]

#: Invoice-likeness: present patterns count for or against.
LIKE_POSITIVE = [
    r"\binvoice\b", r"\binvoice\s*(?:no|number|#)\b", r"\binvoice\s*date\b", r"\bbill\s*to\b", r"\bsold\s*to\b",
    r"\bamount\s+due\b", r"\btotal\s+amount\s+due\b", r"\bpayment\s+terms\b",
]
LIKE_NEGATIVE = [
    r"\bquotation\b", r"\bquote\b", r"\bremittance advice\b", r"\bvoucher\b", r"\bcheck request\b", r"\bnon-negotiable\b", r"\bpay to the order of\b",
]

#: Templates in order of precedence, with the weight of each hit.
TEMPLATES = {
    "lab_invoice": (2, [r"\bhazleton\b", r"\blaboratories?\b", r"\blorillard research center\b", r"\battention\b", r"\battn\b", r"\bleesburg turnpike\b"]),
    "law_firm_letterbill": (2, [r"\bprofessional corporation\b", r"\bwe appreciate the opportunity to serve you\b", r"\bthis bill total\b", r"\bcurrent professional services\b", r"\bdisbursements\b", r"\bdue upon receipt\b", r"\bre:\b"]),
    "remittance_advice": (2, [r"\bremittance advice\b", r"\bclient total\b", r"\bremittance total\b", r"\breference no\b", r"\bvendor code\b", r"\binvoice amount\b", r"\bamount less\b"]),
    "tabular_invoice": (2, [r"\btotal amount due\b", r"\bpayment terms\b", r"\bcustomer number\b", r"\bunit price\b", r"\bquantity\b", r"\bdescription\b", r"\bsold to\b", r"\bshipped to\b"]),
    "generic_invoice": (1, [r"\binvoice\b", r"\binvoice date\b", r"\btotal\b", r"\bamount due\b", r"\bbill to\b", r"\bto:\b"]),
}

CODE = r"([A-Z0-9][A-Z0-9\-\/]{2,24})"
BASELINE_NUMBER = [
    rf"(?:invoice|invorce|lnvoice|invoace)\s*(?:no|number|num|#)?\.?\s*[:\-#]?\s*{CODE}",
    rf"\breference\s*(?:no|#)?\s*[:\-]?\s*{CODE}",
    rf"\bour\s*file\s*no\.?\s*[:\-]?\s*{CODE}",
    rf"\bdoc(?:ument)?\s*(?:no|#)\s*[:\-]?\s*{CODE}",
    rf"\bestimate\s*#\s*{CODE}",
]
_WRITTEN = r"([A-Za-z]+\s+\d{1,2},?\s+\d{4})"
_SLASHED = r"(\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4})"
BASELINE_DATE = [
    rf"invoice\s*date[_\s:.\-]*{_WRITTEN}",
    rf"invoice\s*date[_\s:.\-]*{_SLASHED}",
    rf"\bdated?\s+{_WRITTEN}",
    rf"\bdate\s*[_\s:]{{1,10}}{_WRITTEN}",
    rf"\bdate\s*[_\s:]{{1,10}}{_SLASHED}",
    r"\b((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})\b",
    r"\b([A-Za-z]{3,4}\s+\d{1,2},?\s+\d{4})\b",
]
BASELINE_DUE = [
    rf"due\s*date\s*[:\-_]?\s*{_SLASHED}",
    rf"due\s*date\s*[:\-_]?\s*{_WRITTEN}",
    rf"pay(?:ment)?\s+(?:due|by)\s*[:\-]?\s*{_SLASHED}",
    rf"terms?\s*[_\s:]{{0,5}}net\s+{_SLASHED}",
    rf"\bdue\s+{_SLASHED}",
]
PAYMENT_TERMS = [
    r"\b(net\s*\d{1,3}(?:\s*days?)?)\b", r"\b(due\s+upon\s+receipt)\b", r"\b(payment\s+is\s+due\s+upon\s+receipt)\b", r"\b(cash\s+\d+\s*days?)\b", r"\b(COD)\b",
]
COMPANY = (
    r"\b(inc\.?|corp\.?|ltd\.?|llc\.?|co\.?|company|companies|laboratories?|labs?|associates?|partners?|group|institute|"
    r"industries|international|consulting|services?|research|communications?|advertising|corporation)\b"
)
COMPANY_TEMPLATE = COMPANY.replace("corporation)", "corporation|center)")
BAD_NAME = [
    r"\b(invoice|date|amount|total|terms|page|phone|telephone|fax|attn|sold to|bill to|ship to)\b",
    r"\b(remittance|quotation|voucher|check|non-negotiable)\b",
    r"\$",
]
BAD_PARTY = r"\b(amount|total|invoice|date|terms|advertising|request|requisition|copy|client)\b"
RECIPIENT_LABEL = r"(?:\bbill\s*to\b|\bsold\s*to\b|\bship\s*to\b|^to\s*:?$)"
BLOCK_STOP = r"\b(invoice|date|terms|amount|total|description|qty|quantity)\b"
ATTENTION = r"att(?:n|ention)\.?\s+(?:dr\.?\s+|mr\.?\s+|ms\.?\s+|mrs\.?\s+)?([A-Za-z][A-Za-z\s\.\-&]{3,60})"
AMOUNT = r"\$?\s*([\d,]+(?:\.\d{2})?)"

#: Layout scoring.
LAYOUT_COMPANY = r"\b(inc\.?|corp\.?|ltd\.?|company|corporation|group|institute|research|center|services?|laboratories?)\b"
STRONG_TOTAL = r"\b(total amount due|amount due|balance due|net amount|this bill total)\b"

#: Regex engine v5 and the rows in which older versions differ.
LABEL_CODE = r"([A-Z0-9][\w\-/\.]{2,30})"
V5_NUMBER = [
    rf"invoice\s+(?:no|number|num|id|#)\.?\s*[:\-#]?\s*{LABEL_CODE}",
    rf"inv\.?\s*(?:no|number|#)\.?\s*[:\-]?\s*{LABEL_CODE}",
    rf"invoice\s*[:#]\s*{LABEL_CODE}",
    rf"proforma\s*(?:invoice)?\s*(?:no|number|num|#)\.?\s*[:\-]?\s*{LABEL_CODE}",
    rf"(?:our\s+ref|reference|ref)\.?\s*(?:no\.?|number|#)?\s*[:\-]\s*{LABEL_CODE}",
    rf"tax\s+invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*{LABEL_CODE}",
    rf"p\.?o\.?\s*(?:no\.?|number|#)\s*[:\-]?\s*{LABEL_CODE}",
    r"(?<!\w)#([A-Z0-9][\w\-/]{3,30})",
    r"I\s+N\s+V\s+O\s+I\s+C\s+E\s+N\s*o\.?\s*[:\-]?\s*([A-Z0-9][\w\-/]{2,30})",
    rf"(?:booking\s*(?:id|no|number|#)|confirmation\s*(?:no|number|#)?|folio)\s*[:\-#]?\s*{LABEL_CODE}",
]
V5_NUMBER_STOP = r"^(date|from|to|bill|billing|pay|payment|due|amount|total|subtotal|please|invoice|reference|page|sheet|period|no|number)$"
_DATE_TEXT = r"([A-Za-z\d][A-Za-z\d\s,/\-\.]{3,30})"
V5_DATE = [
    rf"invoice\s+date\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"issue\s+date\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"billing\s+date\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"(?<![Dd][Uu][Ee] )dated?\s*[:\-]?\s*{_DATE_TEXT}",
    rf"(?<![Dd][Uu][Ee]\s)(?<![Pp][Aa][Yy]\s)(?:^|(?<=\s)|(?<=\n))date\s*:\s*{_DATE_TEXT}",
]
V5_DUE = [
    rf"due\s*(?:date|by|on)?\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"payment\s*(?:due|by|date)\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"pay(?:ment)?\s*by\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"valid\s*(?:until|through|to)\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"expir(?:es|y)\s*[:\-=]?\s*{_DATE_TEXT}",
    rf"payment\s+by\s*[:\-=]?\s*{_DATE_TEXT}",
]
WRITTEN_DATE = r"\b((?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})\b"
V5_TERMS = r"\b(net\s*\d{2,3}(?:\s*days?)?|due\s+on\s+receipt|payable\s+immediately|upon\s+receipt|cash\s+\d+\s*days?|COD)\b"
_SIGN = r"[£$€¥₹]"
#: (pattern, labelled) of amounts.
V5_AMOUNT = [
    (
        r"(?:total\s+amount\s+due|amount\s+due|balance\s+due|total\s+due|total\s+invoice\s+value|grand\s+total|amount\s+payable|"
        rf"please\s+pay|net\s+amount\s+due)\s*[:\-]?\s*(?:{_SIGN}|[A-Z]{{3}})?\s*([\d,\.]+)",
        True,
    ),
    (rf"T\s+O\s+T\s+A\s+L\s*[:\-]?\s*{_SIGN}?\s*([\d,\.]+)", True),
    (rf"(?:total|amount|balance)\s*[:]?\s*{_SIGN}\s*([\d,\.]+)", True),
    (rf"{_SIGN}\s*([\d,]+\.?\d{{0,2}})", False),
    (r"([\d,]+\.?\d*)\s*(?:usd|eur|gbp|aud|inr|chf)\b", False),
    (r"(?:total|amount|balance)\s*[:\-]?\s*([\d,]+\.\d{2})", True),
    (rf"(?:total\s+invoice|total|importe\s+total|montant\s+total)\s*\n\s*(?:{_SIGN}\s*)?([\d,\.]+)", True),
]
V5_COMPANY = (
    r"\b(inc\.?|corp\.?|ltd\.?|llc\.?|llp\.?|pty\.?|co\.?|company|companies|gmbh|ag|s\.l\.?|s\.a\.?|b\.v\.?|n\.v\.?|plc\.?|"
    r"laboratories?|labs?|associates?|partners?|group|institute|industries|international|consulting|solutions?|technologies?|"
    r"services?|communications?|newspapers?|advertising|research|properties|media|studio|studios?|agency|legal|attorneys?|law|"
    r"engineering|construction|welding|fabrication|supply|trading|photography|creative|design|publishing|catering|medical|"
    r"advisory|management|ventures?|holdings?|capital)\b"
)
V5_SELLER_LABEL = r"(?:from|vendor|issued\s+by|billed\s+from|seller)\s*[:\-]?\s*([^\n]{4,80})"
V5_BILL_TO = r"(?:bill(?:ed)?\s*(?:to|from)|sold\s*to|ship\s*to|billed\s*to|invoice\s*to|pay(?:able)?\s*to|remit\s*to)"
V5_DOC_TYPES = (
    "invoice|tax invoice|proforma invoice|proforma|receipt|payment receipt|sales receipt|quotation|quote|estimate|statement|purchase order|"
    "delivery note|credit note|debit note|remittance|bill|billing statement|retail invoices/bill|retail invoices"
).split("|")
_PARTY = (
    r"bill(?:ed)?\s*to|sold\s*to|ship\s*to|invoice\s*to|billed\s*to|pay(?:able)?\s*to|remit\s*to|customer(?:\s*name)?|client(?:\s*name)?|"
    r"buyer(?:\s*name)?|recipient(?:\s*name)?|guest(?:\s*name)?|attn(?:ention)?|cliente|comprador|destinatario|acheteur"
)
V5_PARTY_LABEL = rf"^(?:{_PARTY})\b"
V5_PARTY_STRIP = rf"^(?:{_PARTY})\s*[:\-]?\s*"
V5_PARTY_BAD = (
    r"\b(invoice|tax invoice|date|due|subtotal|total|amount|balance|vat|tax|bank|branch|swift|iban|gst|nif|cif|po number|order number|"
    r"email|site|website|www\.|http|tel|phone|mobile|fax|method of payment|payment method|"
    r"supplier code|badge|hotel details|check in|check out|room)\b"
)
V5_PARTY_EXACT = r"^(name|customer|client|buyer|recipient|guest|attention|attn|bill to|ship to|sold to|bill|sold|code|from|data|details|ship|remit)$"
V5_PARTY_SAME_LINE = [
    r"(?:bill(?:ed)?\s*to|sold\s*to|ship\s*to|invoice\s*to|billed\s*to|pay(?:able)?\s*to|remit\s*to)\s*[:\-]?\s*([^\n]{2,120})",
    r"(?:customer|client|buyer|recipient|guest)(?:\s*name)?\s*[:\-]?\s*([^\n]{2,120})",
    r"attn(?:ention)?\s*[:\-.]?\s*([^\n]{2,120})",
    r"(?:cliente|comprador|destinatario|acheteur|facturer\s*[àa])\s*[:\-]?\s*([^\n]{2,120})",
]
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
V5_PARTY_EMAIL = r"(?:customer|client|buyer|recipient|guest)[^\n]{0,60}\n?([^\n]*@[\w\.-]+\.\w+)"
ALL_CAPS_NAME = r"^(?:[A-ZÁÉÍÓÚÑÜ]{4,15})(?:\s+[A-ZÁÉÍÓÚÑÜ]{4,15}){1,3}$"
ALL_CAPS_STOP = (
    r"\b(?:TOTAL|INVOICE|FACTURA|TICKET|RECEIPT|CUSTOMER|DATA|CLIENT|BILL|PAYMENT|AMOUNT|DATE|NUMBER|ADDRESS|COUNTRY|CITY|PHONE|EMAIL|TAX|VAT|"
    r"GSTIN|GST|CIN|PAN|IBAN|SWIFT|SRN|HSN|SAC|SUBTOTAL|DISCOUNT|SHIPPING|ORIGINAL|COPY|BALANCE|DUE|PAID|REF|QTY|DESCRIPTION)\b"
)
BAD_RECIPIENT_EXACT = r"^(bill|bill to|ship to|sold to|customer|customer data|client|buyer|recipient|guest|attn|attention|details|data|code)$"
BAD_RECIPIENT_WORD = (
    r"\b(invoice|date|due|subtotal|total|amount|balance|vat|tax|supplier code|badge|hotel details|check in|check out|room|data|details|"
    r"telephone|phone|tel|customer service)\b"
)
BAD_RECIPIENT_COUNTRY = r"^[A-ZÁÉÍÓÚÜÑ ]+\((?:SPAIN|FRANCE|IRELAND|ECUADOR|GERMANY|NETHERLANDS)\)$"
BAD_ISSUER_EXACT = r"^(bill|from|vendor|seller|supplier|invoice|neon\s+sign|no\.?|customer|customer\s+data|data|details|code|payment\s+receipt)$"
BAD_ISSUER_PLACE = r"\b(?:business\s+campus|business\s+park|industrial\s+park|shopping\s+centre|shopping\s+center|wholesaler|warehouse|logistics\s+centre|logistics\s+center)\b"
BAD_ISSUER_CAPS = r"^(?:[A-ZÁÉÍÓÚÑÜ]{4,15})(?:\s+[A-ZÁÉÍÓÚÑÜ]{4,15}){1,2}$"
BAD_ISSUER_TEXT = r"(spanish to english|english to spanish|onlinedoc|onlinedoctranslator|translation|translated by|^original$|^copy$|www\.|http|@|payment\s+receipt)"
BAD_ISSUER_COUNTRY = (
    r"^(united states|spain|españa|france|ecuador|ireland|germany|netherlands|united kingdom|uk|usa|eu|europe|madrid|barcelona|paris|london|dublin|berlin|amsterdam|quito)$"
)
GENERIC_DOMAINS = "gmail hotmail yahoo outlook icloud live aol mail protonmail msn me gmx inbox fastmail zoho".split()
RECIPIENT_ANCHOR = r"\b(bill(?:ed)?\s*to|sold\s*to|ship\s*to|invoice\s*to|customer|client|recipient|attn|delivery\s*address)\b"
