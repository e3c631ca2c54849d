"""Keyword tables for classification (K1, K7) and column mapping (M2).

Fixed values (must equal the reference for the same classification): the
ordered keyword lists per category and per expense type, matched as
substrings of the folded account name, first class in list order wins; and
the header synonyms per canonical field. They are data; the matching is done
by ``rlike`` over one alternation per class.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Category keywords, in rule order (first match wins).
# ---------------------------------------------------------------------------
CATEGORY_KEYWORDS = [
    ("Other", [
        "ertekcsokken", "ecs leiras", "terven feluli", "amortiz", "depreciat",
        "kamat", "interest", "arfolyam", "exchange difference", "fx ",
        "penzugyi muveletek", "financial expense", "financial income",
        "tarsasagi ado", "income tax", "corporate tax", "deferred tax",
        "rendkivuli", "extraordinary", "impairment", "ertekveszt",
        "abschreibung", "zinsen", "steuer vom einkommen", "ausserordentlich",
    ]),
    ("Revenue", [
        "arbevetel", "ertekesites", "bevetel", "revenue", "sales", "turnover",
        "income from", "fee income", "subscription income", "net sales",
        "erlose", "umsatzerlose", "umsatz", "ertrage aus",
    ]),
    ("COGS", [
        "anyagkoltseg", "anyagjellegu", "kozvetlen", "elabe", "eladott aru",
        "eladott (koz)vetitett", "alapanyag", "alkatresz",
        "cost of sales", "cost of goods", "cogs", "direct labour",
        "direct labor", "material", "component", "merchandise", "purchases",
        "wareneingang", "wareneinsatz", "rohstoffe", "fremdleistung",
        "freight", "fuvar", "szallitasi koltseg", "hosting", "infrastructure",
    ]),
    ("OpEx", [
        "berkoltseg", "ber ", "berek", "szemelyi jellegu", "bergarulek",
        "jarulek", "szocialis hozzajarulas", "premium", "jutalom", "bonusz",
        "igenybe vett szolgaltatas", "egyeb szolgaltatas", "berleti",
        "iroda", "rezsi", "marketing", "hirdetes", "reklam", "biztositas",
        "utazas", "kikuldetes", "reprezentacio", "szoftver", "licenc",
        "konyveles", "ugyved", "tanacsadas", "alvallalkozo", "megbizasi",
        "salary", "salaries", "wage", "payroll", "personnel", "staff",
        "advertis", " ads", "ads ", "promotion", "rent", "office", "utilit",
        "facilit",
        "insurance", "travel", "entertainment", "software", "licence",
        "license", "consult", "legal", "audit", "professional",
        "contractor", "recruit", "training", "telephone", "telecom",
        "operating expense", "egyeb rafordit", "egyeb koltseg", "overhead",
        "occupancy", "repairs", "maintenance", "karbantartas",
        "lohne", "gehalter", "personalkosten", "miete", "raumkosten",
        "werbung", "versicherung", "reisekosten", "buromaterial",
    ]),
]

# ---------------------------------------------------------------------------
# Expense-type keywords, in rule order (first match wins).
# ---------------------------------------------------------------------------
EXPENSE_TYPE_KEYWORDS = [
    ("Depreciation & amortisation", ["ertekcsokken", "ecs", "amortiz", "depreciat"]),
    ("Financing & bank", ["kamat", "banki", "bankkolts", "penzugyi muveletek",
                          "interest", "bank charge", "bank fee", "financing"]),
    ("Payroll benefits", ["bergarulek", "jarulek", "szocialis hozzajarulas",
                          "szocho", "payroll tax", "social contribution",
                          "national insurance", "pension", "benefit"]),
    ("Employee incentives", ["premium", "jutalom", "bonusz", "osztonzo",
                             "bonus", "incentive", "commission"]),
    ("External staff / contractors", ["alvallalkozo", "megbizasi", "kolcsonzott",
                                      "contractor", "external staff", "agency",
                                      "temporary staff", "freelance"]),
    ("Direct labour", ["kozvetlen ber", "direct labour", "direct labor"]),
    ("Salaries & wages", ["berkoltseg", "berek", "ber ", "szemelyi jellegu",
                          "munkaber", "salary", "salaries", "wage", "payroll",
                          "personnel cost", "staff cost"]),
    ("Marketing & advertising", ["marketing", "hirdetes", "reklam", "promocio",
                                 "advertis", "promotion", "campaign", "brand"]),
    ("External professional fees", ["konyveles", "ugyved", "jogi", "tanacsadas",
                                    "konyvvizsgal", "audit", "legal", "consult",
                                    "professional fee", "advisory"]),
    ("IT & software", ["szoftver", "informatik", "software", "saas", "it cost",
                       "subscription"]),
    ("Third-party licences", ["licenc", "jogdij", "licence", "license",
                              "royalty", "third-party"]),
    ("Hosting & infrastructure", ["hosting", "szerver", "felho", "cloud",
                                  "infrastructure", "datacent", "aws", "azure"]),
    ("Facilities & office", ["berleti", "iroda", "rezsi", "kozuzemi", "takaritas",
                             "rent", "office", "utilit", "facilit", "cleaning",
                             "premises"]),
    ("Travel & entertainment", ["utazas", "kikuldetes", "reprezentacio", "travel",
                                "entertainment", "hotel", "mileage", "subsistence"]),
    ("Insurance", ["biztositas", "insurance"]),
    ("Materials & components", ["anyagkoltseg", "anyagjellegu", "alapanyag",
                                "alkatresz", "anyag", "material", "component",
                                "raw ", "consumable"]),
    ("Logistics & fees", ["szallitas", "fuvar", "logisztika", "logistics",
                          "freight", "shipping", "delivery", "courier",
                          "customs"]),
]

# ---------------------------------------------------------------------------
# Header synonyms per canonical field (English + Hungarian),
# in canonical field order.
# ---------------------------------------------------------------------------
CANONICAL = ["account_code", "account_name", "actual", "budget", "prior_year",
             "debit", "credit", "dc_indicator",
             "period", "category", "expense_type", "department", "cost_centre", "entity"]
REQUIRED = ["account_code", "account_name"]
AMOUNT_FIELDS = ["actual", "budget", "debit", "credit"]
SYNONYMS = {
    "account_code": ["account", "account code", "acct", "acct no", "account no",
                     "account number", "gl account", "gl code", "gl", "nominal",
                     "nominal code", "code", "szamla", "szamlaszam", "fokonyvi szam",
                     "fokonyvi szamla", "number"],
    "account_name": ["account name", "name", "description", "account description",
                     "account desc", "gl name", "gl description", "account text",
                     "megnevezes", "szamla megnevezes", "szamla nev", "leiras"],
    "actual": ["actual", "actuals", "amount", "amt", "value", "actual amount",
               "ytd actual", "balance", "net", "net amount", "osszeg", "teny",
               "actual eur", "amount eur", "current", "current year", "tenyleges"],
    "budget": ["budget", "budgeted", "plan", "planned", "forecast", "budget amount",
               "terv", "budget eur", "bud", "tervezett", "keret"],
    "prior_year": ["prior year actual", "prior year actuals", "py actual", "prior yr act",
                   "prior year", "prior", "py", "last year", "ly", "prior yr",
                   "previous year", "last year actual", "elozo ev", "elozo evi teny",
                   "tavaly", "bazis"],
    "debit": ["debit", "debit amount", "dr", "dr amount", "debits", "tartozik",
              "tartozik osszeg", "terheles", "t oldal"],
    "credit": ["credit", "credit amount", "cr", "cr amount", "credits", "kovetel",
               "kovetel osszeg", "jovairas", "k oldal"],
    "dc_indicator": ["dc", "d c", "dc indicator", "debit credit", "debit credit indicator",
                     "debit/credit", "posting indicator", "sign", "d/c",
                     "tartozik kovetel", "t k", "egyenleg iranya"],
    "category": ["category", "type", "account type", "pnl category", "kategoria",
                 "csoport", "class", "tipus"],
    "department": ["department", "dept", "division", "function", "org unit",
                   "organisational unit", "reszleg", "osztaly", "divizio", "terulet"],
    "cost_centre": ["cost centre", "cost center", "cost centre code", "cost center code",
                    "cc code", "cc no", "cost centre no", "cc id", "cctr", "cc",
                    "koltseghely", "koltseghely kod", "kh kod", "kh",
                    "koltseghely azonosito", "szervezeti egyseg"],
    "period": ["period", "accounting period", "posting period", "fiscal period",
               "reporting period", "year month", "yearmonth", "month", "per",
               "idoszak", "konyvelesi idoszak", "elszamolasi idoszak", "honap",
               "periodus", "targyhonap"],
    "expense_type": ["expense type", "cost type", "expense category", "cost category",
                     "nature", "expense nature", "koltsegnem", "koltseg tipus",
                     "koltseg kategoria", "kiadas tipusa"],
    "entity": ["entity", "company", "legal entity", "company code", "subsidiary",
               "entitas", "ceg", "tarsasag", "tarsasagi kod"],
}
CURRENCY_HEADERS = ["currency", "ccy", "curr", "devizanem", "deviza", "penznem"]


def alternation(words: list[str]) -> str:
    """One regex matching any of the literal words as a substring."""
    return "|".join("\\Q" + w + "\\E" for w in words)
