"""The rules by which pages are told apart, in the order in which they are tried."""

# Provider, pattern on the page's URL, and template of its listing API. The first match wins, at confidence 0.9.
URL_RULES = [
    ("greenhouse", r"boards\.greenhouse\.io|greenhouse\.io/embed", "https://boards-api.greenhouse.io/v1/boards/{board}/jobs?content=true"),
    ("lever", r"jobs\.lever\.co", "https://api.lever.co/v0/postings/{board}?mode=json"),
    ("ashby", r"jobs\.ashbyhq\.com|ashby\.io", None),
    ("workday", r"\.myworkdayjobs\.com|workday\.com", None),
    ("icims", r"\.icims\.com|icims\.com", None),
    ("rippling", r"(?i)ats\.rippling\.com|rippling\.com/careers", None),
    ("workable", r"(?i)\.workable\.com", None),
    ("bamboohr", r"(?i)\.bamboohr\.com/careers", None),
    ("smartrecruiters", r"(?i)jobs\.smartrecruiters\.com", "https://api.smartrecruiters.com/v1/companies/{board}/postings"),
    ("personio", r"(?i)jobs\.personio\.de", None),
    ("jobvite", r"(?i)jobs\.jobvite\.com", None),
    ("teamtailor", r"(?i)\.teamtailor\.com|api\.teamtailor\.com", None),
    ("recruitee", r"(?i)\.recruitee\.com", None),
    ("pinpoint", r"(?i)\.pinpointhq\.com", None),
    ("breezy", r"(?i)\.breezy\.hr", None),
    ("phenom", r"(?i)phenom\.com|phenompeople\.com", None),
    ("eightfold", r"(?i)\.eightfold\.ai", None),
    ("sap_successfactors", r"(?i)successfactors\.com|career\.sap\.com", None),
]
URL_CONFIDENCE = 0.9

# Provider, pattern on the page's HTML, confidence. The highest confidence wins, the earliest of equals.
DOM_RULES = [
    ("greenhouse", r"(?i)boards\.greenhouse\.io|id=['\"]greenhouse", 0.85),
    ("lever", r"(?i)lever-jobs-container|jobs\.lever\.co", 0.85),
    ("ashby", r"(?i)ashby-job-posting|ashbyhq\.com", 0.8),
    ("workday", r"(?i)myworkdayjobs\.com|workday", 0.7),
    ("icims", r"(?i)icims\.com|class=['\"]iCIMS", 0.75),
    ("rippling", r"(?i)ats\.rippling\.com|rippling-ats", 0.85),
    ("workable", r"(?i)\.workable\.com|workable-board", 0.85),
    ("bamboohr", r"(?i)bamboohr\.com/careers|bamboohr-app", 0.85),
    ("smartrecruiters", r"(?i)smartrecruiters\.com|smartrecruiters-app", 0.85),
    ("personio", r"(?i)personio\.de|personio\.com|personio-", 0.85),
    ("jobvite", r"(?i)jobvite\.com|jobvite-", 0.85),
    ("teamtailor", r"(?i)teamtailor\.com|tt-job|data-teamtailor", 0.85),
    ("recruitee", r"(?i)recruitee\.com|rt-job|recruitee-job", 0.85),
    ("pinpoint", r"(?i)pinpointhq\.com|pinpoint-job|data-pinpoint", 0.85),
    ("breezy", r"(?i)breezy\.hr|breezy-position|data-breezy", 0.85),
    ("phenom", r"(?i)phenom\.com|phenompeople\.com|class=['\"][^'\"]*ph(?:w)?-", 0.85),
    ("eightfold", r"(?i)eightfold\.ai|class=['\"][^'\"]*(?:eightfold-|efai-)", 0.85),
    ("sap_successfactors", r"(?i)successfactors\.com|sfsf-|SAP SuccessFactors", 0.85),
]

# Score and pattern of a candidate careers URL; the highest score wins.
URL_SCORES = [
    (1.0, r"(?i)boards\.greenhouse\.io|greenhouse\.io/embed"),
    (1.0, r"(?i)jobs\.lever\.co"),
    (1.0, r"(?i)jobs\.ashbyhq\.com|ashby\.io"),
    (1.0, r"(?i)jobs\.smartrecruiters\.com"),
    (0.95, r"(?i)ats\.rippling\.com"),
    (0.9, r"(?i)\.myworkdayjobs\.com|workday\.com"),
    (0.9, r"(?i)\.workable\.com"),
    (0.9, r"(?i)\.bamboohr\.com/careers"),
    (0.9, r"(?i)jobs\.personio\.de"),
    (0.9, r"(?i)jobs\.jobvite\.com"),
    (0.85, r"(?i)\.icims\.com"),
    (0.5, r"(?i)/careers|/jobs"),
]
LEAST_URL_SCORE = 0.5

# Patterns of the page validator.
CANONICAL_REJECT = r"(?i)/(blog|news|press|investors?|ir|archive)([/\-_?#]|$)"
URL_HINT = r"(?i)/(careers?|jobs?|positions?|openings?|join|opportunities?)([/\-_?#]|$)"
TITLE_HINT = r"(?i)\b(careers?|open\s+roles?|we\s+are\s+hiring|join\s+us|work\s+with\s+us|job\s+openings?)\b"
LIST_SIGNAL = r"(?i)(job[-_]?card|job[-_]?listing|position[-_]?item|role[-_]?item|opening[-_]?row|data-job-id|class=[\"']job|class=[\"']position|class=[\"']role|aria-label=[\"']job\s+posting)"
JSON_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
OG_TYPE = r"(?i)<meta[^>]+(?:property=[\"']og:type[\"'][^>]+content=[\"']([^\"']+)[\"']|content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:type[\"'])"
PUBLISHED_TIME = r"(?i)article:published_time"
NOINDEX = r"(?i)<meta[^>]+name=[\"']robots[\"'][^>]+content=[^>]*noindex"
CANONICAL = r"(?i)<link[^>]+(?:rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"']|href=[\"']([^\"']+)[\"'][^>]+rel=[\"']canonical[\"'])"
NON_JOB_TYPES = ["BlogPosting", "NewsArticle", "Article"]
TITLE_SCAN = 4096
SPARSE_TEXT = 200

# Names of the page validator's signals, and codes of why a page needs a browser.
POSTING_SIGNAL = "schema_job_posting"
NON_JOB_SIGNAL = "schema_non_job:"
ARTICLE_SIGNAL = "og_article+published_time"
NOINDEX_SIGNAL = "noindex_meta"
CANONICAL_SIGNAL = "canonical_non_job:"
ATS_SIGNAL = "ats_detected:"
URL_SIGNAL = "url_pattern"
TITLE_SIGNAL = "title_match"
SPARSE_SIGNAL = "empty_or_sparse"
NO_LIST_SIGNAL = "no_job_list_signals"
BROWSER_REFUSED = "TIER3_403"
BROWSER_CHALLENGE = "TIER3_CLOUDFLARE"
BROWSER_EMPTY = "TIER3_EMPTY_200"

# Patterns of the extractors.
TAG = r"<[^>]+>"
OPEN_TAG = r"<[^>]+"
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"
SCRIPT_STYLE = r"(?is)<(script|style|noscript)[^>]*>.*?</\1>"
LINK = r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
ASHBY_SLUG_JSON = r'"organizationHostedJobsPageName"\s*:\s*"([^"]+)"'
ASHBY_SLUG_URL = r'ashbyhq\.com(?:/job-board)?/([^/"\s\?#]+)'
ICIMS_LINK = r"(?i)href=[\"']([^\"']*(?:/jobs/\d+/job|module=jobdetail&iis=|JobDetail)[^\"']*)[\"']"
ICIMS_LABEL = r"(?i)(?:aria-label|title)=[\"']([^\"']+)[\"']"
ICIMS_CAPTION = r"(?i)href=[\"'][^\"']+[\"'][^>]*>\s*([^<]{3,80})"
ICIMS_NEAR = 200
WORKDAY_BLOB = r"(?s)\"jobPostings?\"\s*:\s*(\[.*?\])"
NEXT_DATA = r"(?is)<script\s+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
PHENOM_BLOCK = r"(?is)<[^>]+class=[\"'][^\"']*(?:ph-job|phw-job|ph-card|phw-card)[^\"']*[\"'][^>]*>(.*?)</(?:div|article|li)>"
EIGHTFOLD_BLOCK = r"(?is)<[^>]+class=[\"'][^\"']*(?:eightfold-job|efai-job|eightfold-card|efai-card|job-card)[^\"']*[\"'][^>]*>(.*?)</(?:div|article|li)>"
HEADING = r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"
HREF = r"(?i)href=[\"']([^\"']+)[\"']"

# Marks of a challenge page (in lower case), and providers that robots rules and rendering leave alone.
CHALLENGE_MARKS = ["_cf_chl_opt", "cf-browser-verification", "just a moment", "checking your browser"]
BYPASS_PROVIDERS = ["greenhouse", "lever", "ashby"]
CHUNK_CHARS = 6000
SALVAGE_ALERT = 0.10
SALVAGED = "salvaged"
STATUS_SEVERITY = ["clean", "salvaged", "truncated", "failed"]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemal.xml"]
BODY_CAP = 10 * 1024 * 1024
ERROR_CAP = 200
ODATA_PATH = "/odata/v2/JobRequisition"

# Addresses that providers' readers ask for.
TEAMTAILOR_HOST = "api.teamtailor.com"
TEAMTAILOR_API = "https://api.teamtailor.com/v1/jobs?filter[company-slug]="
RECRUITEE_PATH = "/api/offers"
PINPOINT_PATH = "/jobs.json"
BREEZY_PATH = "/json"
PHENOM_API = "https://api.phenom.com/jobs-api/v1/jobs"
ODATA_FORMAT = "$format=json"
ROBOTS_PATH = "/robots.txt"

# Provider, patterns on the page's URL, patterns on its HTML (both in any case), names of script globals, and addresses of its API.
# They are tried in this order: all URL patterns, then all HTML patterns, then all globals.
FINGERPRINTS = [
    (
        "teamtailor", [r"\.teamtailor\.com", r"api\.teamtailor\.com"], [r"teamtailor", r"data-teamtailor", r"tt-job", r"teamtailor-job"],
        ["Teamtailor", "teamtailor"], ["https://api.teamtailor.com/v1/jobs"],
    ),
    (
        "recruitee", [r"\.recruitee\.com"], [r"recruitee", r"rt-job", r"recruitee-job", r"class=['\"][^'\"]*recruitee"],
        ["Recruitee", "recruitee"], ["https://{slug}.recruitee.com/api/offers"],
    ),
    ("pinpoint", [r"\.pinpointhq\.com"], [r"pinpointhq", r"pinpoint-job", r"data-pinpoint"], ["Pinpoint", "PinpointHQ"], ["https://{slug}.pinpointhq.com/jobs.json"]),
    ("breezy", [r"\.breezy\.hr"], [r"breezy\.hr", r"breezy-position", r"data-breezy"], ["breezy", "Breezy"], ["https://{slug}.breezy.hr/json"]),
    (
        "phenom", [r"phenom\.com", r"phenompeople\.com"], [r"class=['\"][^'\"]*(ph-|phw-)", r"phenom-job", r"phenom\.com", r"phenompeople\.com", r"data-phenom"],
        ["Phenom", "PhenomPeople", "phenom"], ["https://api.phenom.com/jobs-api/v1/jobs"],
    ),
    ("eightfold", [r"\.eightfold\.ai"], [r"class=['\"][^'\"]*(eightfold-|efai-)", r"eightfold\.ai", r"data-eightfold"], ["Eightfold", "eightfold", "efai"], []),
    (
        "sap_successfactors", [r"successfactors\.com", r"career\.sap\.com", r"sap\.com/careers"], [r"successfactors", r"sfsf-", r"saphr", r"data-sap-", r"SAP SuccessFactors"],
        ["SuccessFactors", "SFSF", r"sap\.sf"], ["/odata/v2/JobRequisition?$format=json", "/sitemal.xml"],
    ),
]
FINGERPRINT_URL, FINGERPRINT_HTML = 0.9, 0.85

# Fields of the schema that the local model is asked for: name to (type, whether it's required).
POSTING = {
    "title": ("string", True), "url": ("string", True), "company": ("string", False), "location": ("string", False),
    "employment_type": ("string", False), "remote_policy": ("string", False), "description": ("string", False),
    "salary_min": ("double", False), "salary_max": ("double", False), "salary_currency": ("string", False),
    "posted_at": ("timestamp", False), "apply_url": ("string", False),
}
