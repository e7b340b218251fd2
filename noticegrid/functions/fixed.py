"""Word lists, code tables and patterns that results depend on."""

# --- Fixed values: dates -------------------------------------------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
FI_DATE = r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)(?:\s+(?:klo\s*)?(\d{1,2})[:.](\d{2}))?"
FI_RANGE = r"(?<!\d)(\d{1,2})\.(\d{1,2})\.\s*[–-]\s*(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)"
EN_DATE = (
    r"(?i)(?<!\d)(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+(\d{4})(?!\d)(?:[,\s(]+(\d{1,2})[:.](\d{2}))?"
)
ISO_DATE = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?:[ T]+(\d{2}):(\d{2})(?::\d{2})?)?(?!\d)"
# Zone names accepted as known: UTC forms, fixed offsets, and region/city.
KNOWN_ZONE = (
    r"^(UTC|GMT|Etc/(UTC|GMT([+-]\d{1,2})?)|(Africa|America|Antarctica|Arctic|Asia|Atlantic|Australia|Europe|"
    r"Indian|Pacific)/[A-Za-z_+\-]+(/[A-Za-z_+\-]+)?)$"
)

# --- Fixed values: enumerations ------------------------------------------------------------
RECORD_KINDS = ("call", "funding_scheme", "advance_information")
INSTRUMENTS = ("grant", "loan", "guarantee", "prize", "technical_assistance", "other")
SOURCE_STATUSES = ("open", "forthcoming", "closed", "rolling", "unknown", "cancelled")
SCOPES = ("eu", "finland", "pirkanmaa", "other_region", "unknown", "international")
DETAIL_LEVELS = ("listing", "full", "manual")
TAG_KINDS = ("theme", "region", "applicant", "keyword")
TAG_BASES = ("source", "rule")
ELIGIBILITIES = ("unreviewed", "eligible", "conditional", "ineligible")
CITY_ROLES = ("unknown", "lead", "partner", "beneficiary")
LIMITS = {
    "external_id": 400, "canonical_url": 2048, "title": 1000, "funder": 500, "programme": 200,
}
CURRENT_STATUSES = ("open", "forthcoming", "rolling")

# --- Fixed values: status words and codes --------------------------------------------------
STATUS_WORDS = {
    "avoinna": "open", "avoin": "open", "haettavana": "open", "tulossa": "forthcoming",
    "päättynyt": "closed", "suljettu": "closed", "jatkuva": "rolling",
    "open": "open", "closed": "closed", "open call": "open", "closed call": "closed",
    "forthcoming": "forthcoming", "käynnissä": "open",
}
PORTAL_STATUS = {"avoin": "open", "tulossa": "forthcoming", "paattynyt": "closed"}
SEARCH_STATUS = {"31094501": "forthcoming", "31094502": "open", "31094503": "closed"}
PRIMARY_DATASOURCE = "SEDIA"
SEARCH_SOURCE = "eu-funding"
CASCADE_PREFIX = "cascade:"
CASCADE_PROGRAMME = "EU cascade funding"

# --- Fixed values: themes ------------------------------------------------------------------
THEMES = {
    "Ilmasto ja energia": ["climat", "ilmasto", "energia", "energy", "hiilineutra", "decarbon"],
    "Digitalisaatio ja tekoäly": ["digital", "tekoäly", "artificial intelligence", "data space", "cyber"],
    "Osaaminen ja koulutus": ["education", "koulutus", "osaami", "skills", "learning"],
    "Työllisyys ja elinvoima": ["employment", "työllis", "elinvoima", "entrepreneur", "innovation", "innovaat"],
    "Kulttuuri ja liikunta": ["culture", "kulttuuri", "liikunta", "sport", "heritage"],
    "Hyvinvointi ja osallisuus": ["wellbeing", "hyvinvoin", "health", "inclusion", "osallisu", "yhdenvertais"],
    "Liikenne ja kaupunkiympäristö": [
        "mobility", "transport", "liikenne", "urban", "kaupunki", "built environment"],
    "Luonto ja kiertotalous": ["biodivers", "luonto", "circular", "kiertotal", "water", "vesistö"],
    "Turvallisuus ja varautuminen": ["security", "turvallis", "resilience", "varautu", "disaster"],
}

# --- Fixed values: text patterns -----------------------------------------------------------
ELIGIBILITY_LINE = (
    r"(?iu)voivat hakea|voi hakea|hakukelpoi|hakijaksi|who can apply|eligible applicant|eligibility|public sector|"
    r"julkiset|julkisen sektorin|yhteisöt|organisations can apply"
)
ELIGIBILITY_LENGTH = 18000
CHALLENGE_TITLE = (
    r"(?iu)just a moment|access denied|verify you are human|page not found|sivua ei löytynyt|"
    r"sidan hittades inte|403 forbidden"
)
DEADLINE_LABEL = (
    r"^(?:call closes|deadline for (?:applications|proposals)|application deadline|submission deadline)\s*:"
)
# --- Fixed values: link policy -------------------------------------------------------------
DOCUMENT_URL = r"(?i)\.(pdf|doc[xm]?|xls[xm]?|ppt[xm]?|odt|ods|odp|rtf|zip)(?:$|[?#])"
RELEVANT = (
    r"(?iu)ehto|my.nt.perust|arviointiperust|valintaperust|hakuohje|liite|hakuilmoit|hakukuulut|"
    r"lis.tieto|tarkemmat.tiedot|ulkoinenAsiointipalveluUrl|usein[\s_-]+kysyt|"
    r"kysymy(?:kset|ksi[aä])[\s_-]+ja[\s_-]+vastau|vastau\w*[\s_-]+kysym|"
    r"rahoitusohje|avustusohje|hakeminen|rahoituksen-hak|"
    r"general.terms|terms.and.conditions|conditions|eligibil|criteri|guideline|guidance|annex|appendi|"
    r"call.document|call.text|call.for.proposal|work.programme|reference.document|faq|"
    r"questions?[\s_-]+(?:and[\s_-]+)?answers?|fr[åa]gor[\s_-]+och[\s_-]+svar|"
    r"further.?information|more.?information|supporting.document|application.guide|application.form|dossier|"
    r"funding.rules|financial.regulation|model.grant|f.rordning|villkor|anvisning|bilag"
)
INFORMATION = (
    r"(?iu)programme[\s_/-]+manual|programme[\s_/-]+region[\s_/-]+map|call[\s_-]+calendar|"
    r"funding/checklist|/rahoitus/haut/|esityslist|p[öo]yt[äa]kir|kokousaineisto"
)
NAVIGATION = (
    r"(?iu)privacy|cookies?|tietosuoja|saavutettavuusseloste|accessibility.statement|"
    r"/login|/signin|/sign-in|kirjaudu|/wp-json|/wp-admin|/api/yllapito|/api/avustus(?:hakemus|asia)|"
    r"facebook.com|linkedin.com|twitter.com|youtube.com|instagram.com|subscribe|newsletter"
)

# --- Fixed values: documents ---------------------------------------------------------------
DOWNLOAD_RETURNED_HTML = "DOCUMENT_DOWNLOAD_RETURNED_HTML"
REDIRECTED_TO_FRONT = "DETAIL_REDIRECTED_TO_FRONT_PAGE"
HTML_TYPES = ("text/html", "application/xhtml+xml")
FRONT_PATHS = ("", "fi", "en", "sv")
ROOT_SECTIONS = ("yleistiedot", "hakuaika", "perustiedot", "myontoperusteet", "arviointiperusteet", "lisaehdot")
ROOT_PREFIX = "https://www.haeavustuksia.fi/api/haku/"
CONTENT_KEYS = (
    "topicConditions", "descriptionByte", "caConditions", "caDescription", "description", "beneficiaryAdministration",
)
TOPIC_BODY_MISSING = "full_eu_conditions_not_present_in_source_entry"
FAQ_TEXT_MISSING = "full_faq_question_or_answer_not_published"
FAQ_BODY_MISSING = "full_faq_question_or_answer_not_published"
FAQ_DETAIL_URL = "https://api.tech.ec.europa.eu/search-api/prod/rest/document/{}?apiKey=SEDIA_FAQ"
EXTENSIONS = {
    "application/pdf": ".pdf", "application/json": ".json", "text/html": ".html", "text/plain": ".txt",
    "application/zip": ".zip", "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.oasis.opendocument.text": ".odt", "application/xml": ".xml",
    "application/vnd.oasis.opendocument.spreadsheet": ".ods",
    "application/vnd.oasis.opendocument.presentation": ".odp",
    "application/vnd.ms-word.document.macroenabled.12": ".docm",
    "application/vnd.ms-excel.sheet.macroenabled.12": ".xlsm",
    "application/vnd.ms-powerpoint.presentation.macroenabled.12": ".pptm",
    "application/vnd.ms-powerpoint": ".ppt",
    "text/xml": ".xml", "application/vnd.ms-excel": ".xls", "image/png": ".png",
    "image/jpeg": ".jpg", "application/rtf": ".rtf",
}
NOTES = {
    "ocr_text_requires_human_verification":
        "Tekstiä on tunnistettu kuvista. Tarkista luvut ja ehdot alkuperäisestä tiedostosta.",
    TOPIC_BODY_MISSING: "Julkaisijan hakutietueesta puuttuu varsinainen sisältöteksti.",
    FAQ_BODY_MISSING: "Julkaisijan FAQ-tietueesta puuttuu kysymys tai vastaus.",
    "document_download_returned_html":
        "Asiakirjalinkki palautti verkkosivun. Varsinaista liitetiedostoa ei saatu.",
    "office_layout_and_embedded_objects_need_review":
        "Tarkista asettelu, kuvat ja laskentataulukot alkuperäisestä Office-tiedostosta.",
    "unsupported_format_original_retained":
        "Alkuperäinen tiedosto on tallennettu, mutta sen kokotekstiä ei voitu poimia.",
    "archive_requires_manual_extraction":
        "Alkuperäinen tiedosto on tallennettu, mutta sen kokotekstiä ei voitu poimia.",
    "encrypted_pdf": "Alkuperäinen tiedosto on tallennettu, mutta sen kokotekstiä ei voitu poimia.",
}
NOTE_PREFIXES = {
    "pages_need_visual_or_ocr_review:": ("Tarkista alkuperäisestä sivut ", "."),
    "ocr_page_limit:": ("Kuvista tunnistettavien sivujen keruuraja on ", " sivua."),
}

# --- Fixed values: report labels -----------------------------------------------------------
LABELS = {
    "effective_status": {
        "open": "Avoin", "forthcoming": "Tulossa", "rolling": "Jatkuva", "closed": "Päättynyt",
        "unknown": "Tuntematon", "cancelled": "Peruutettu"},
    "geographic_scope": {
        "eu": "EU", "finland": "Valtakunnallinen", "pirkanmaa": "Pirkanmaa", "other_region": "Muu alue",
        "unknown": "Ei tiedossa", "international": "Kansainvälinen"},
    "eligibility": {
        "unreviewed": "Tarkistamatta", "eligible": "Soveltuu", "conditional": "Ehdollinen",
        "ineligible": "Ei sovellu"},
    "source_health": {
        "success": "Onnistui", "failed": "Virhe", "partial": "Osittainen", "not_run": "Ei ajettu"},
    "content_state": {
        "not_started": "Keruu aloittamatta", "in_progress": "Keruu kesken", "partial": "Osittainen",
        "collected_unverified": "Kerätty, tarkistamatta"},
    "record_kind": {
        "call": "Hakukierros", "funding_scheme": "Rahoitusmuoto", "advance_information": "Ennakkotieto"},
    "instrument": {
        "grant": "Avustus", "loan": "Laina", "guarantee": "Takaus", "prize": "Palkinto",
        "technical_assistance": "Valmistelun tuki", "other": "Muu / tarkistettava"},
}
STATUS_RANK = ("open", "rolling", "forthcoming", "unknown", "closed", "cancelled")

# Parts of Office archives and their media types.
OFFICE_PARTS = {
    "word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}

# Reasons of rejected rows and messages of runs.
NO_IDENTIFIER = "Identifier missing"
NO_SUCH_DAY = "Date outside the calendar"
NO_OFFSET = "Timezone missing from timestamp"
REPEATED_IDENTIFIER = "Identifier repeated in the batch"
REPEATED_CARD = "Conflicting repeated funder card"
EMPTY_RUN = "Unexpected empty collection; source must be checked"
ROWS_REJECTED = "records rejected"
TOTAL_CHANGED = "Advertised total changed between pages; collect again"
EMPTY_PAGE = "Page without notices before the last one"

# Prefix of the flag for an address that cannot be used.
MALFORMED_URL = "malformed_source_url:"

# Who writes change rows of the FAQ catalogue, and why an association goes.
FAQ_ACTOR = "faq_collector"
FAQ_UNLINKED = "FAQ keyword no longer published"
