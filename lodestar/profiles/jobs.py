"""Default "job listings" profile: lexicons, gazetteers, weights and thresholds.

Every operator takes these as parameters; a profile is plain data so the same
operators serve any listing-like table (products, tickets, leads).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These word lists and thresholds must equal the original
# job-listing pipeline's for identical results. Kept in their natural order
# (order matters where a rule takes "the first hit").
# ---------------------------------------------------------------------------

B2B_TERMS = [
    "b2b", "saas", "enterprise", "business solutions", "crm",
    "erp", "cloud platform", "api", "developer tools", "devops",
    "sales enablement", "lead generation", "demand generation",
    "account-based", "abm", "pipeline", "revenue marketing",
]
B2C_TERMS = [
    "b2c", "consumer", "e-commerce", "ecommerce", "retail",
    "fashion", "food", "travel", "hospitality", "gaming",
    "entertainment", "media", "social", "app", "marketplace",
    "lifestyle", "beauty", "health", "fitness", "edtech",
    "brand marketing", "consumer marketing", "brand awareness",
]
D2C_TERMS = [
    "d2c", "dtc", "direct-to-consumer", "direct to consumer",
    "shopify", "online store", "own brand", "brand building",
    "performance marketing", "facebook ads", "meta ads",
    "google ads", "influencer", "retention marketing",
]

# Role-type title rules, checked in this order; first hit wins.
ROLE_TITLE_RULES = [
    ("Growth", ["growth", "performance", "acquisition", "paid"]),
    ("Brand", ["brand", "creative", "communications", "pr"]),
    ("B2B", ["product marketing", "pmm"]),
]

# Relevance score inputs.
TIER1_CITIES = [
    "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad",
    "chennai", "pune", "gurugram", "gurgaon", "noida", "new delhi",
]
HOME_SIGNALS = TIER1_CITIES + [
    "india", "kolkata", "ahmedabad", "jaipur", "lucknow", "chandigarh",
    "kochi", "indore", "nagpur", "coimbatore", "vadodara", "thiruvananthapuram",
    "bhubaneswar", "vizag", "visakhapatnam", "mangalore", "mysore", "surat",
    "patna", "ranchi", "guwahati", "dehradun", "faridabad", "greater noida",
    "navi mumbai", "thane", "pan india", "across india",
]
FOREIGN_SIGNALS = [
    "united states", "usa", "u.s.", "new york", "san francisco", "california",
    "london", "uk", "united kingdom", "dubai", "uae", "singapore", "toronto",
    "canada", "australia", "sydney", "melbourne", "germany", "berlin", "paris",
    "france", "japan", "tokyo", "hong kong", "china", "shanghai", "beijing",
    "amsterdam", "netherlands", "zurich", "switzerland", "seattle", "boston",
    "chicago", "los angeles", "texas", "florida", "denver", "austin",
    "philippines", "manila", "vietnam", "thailand", "bangkok", "jakarta",
    "indonesia", "saudi arabia", "riyadh", "qatar", "doha", "bahrain",
    "ireland", "dublin", "spain", "madrid", "italy", "milan", "brazil",
    "mexico", "south africa", "kenya", "nigeria", "new zealand", "auckland",
]
TITLE_STRONG = [
    "cmo", "chief marketing", "vp marketing", "vp of marketing",
    "vice president marketing", "head of marketing", "director of marketing",
    "marketing director", "head of growth", "director of growth",
    "head of digital", "head of brand",
]
TITLE_GOOD = [
    "marketing", "growth", "brand", "digital marketing",
    "product marketing", "performance marketing",
]
TITLE_WEAK = ["market"]
# Seniority tiers: (points, terms), first tier with a hit wins.
SENIORITY_TIERS = [
    (15, ["cmo", "chief", "vp", "vice president"]),
    (12, ["director", "head"]),
    (8, ["lead", "senior", "avp", "general manager", "gm"]),
    (5, ["manager"]),
]
REMOTE_TERMS = ["remote", "hybrid", "wfh"]
REMOTE_TERMS_WIDE = ["remote", "hybrid", "wfh", "work from home"]

# Region filter gazetteer (inside / outside) used at ingest.
INSIDE_PLACES = [
    "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad", "chennai",
    "kolkata", "pune", "ahmedabad", "jaipur",
    "noida", "gurugram", "gurgaon", "ghaziabad", "faridabad",
    "lucknow", "kanpur", "chandigarh", "indore", "bhopal",
    "nagpur", "surat", "vadodara", "coimbatore", "kochi",
    "thiruvananthapuram", "trivandrum", "visakhapatnam", "vizag",
    "patna", "ranchi", "bhubaneswar", "dehradun", "mysore", "mysuru",
    "mangalore", "mangaluru", "hubli", "nashik", "aurangabad",
    "rajkot", "jodhpur", "udaipur", "agra", "varanasi",
    "allahabad", "prayagraj", "meerut", "jalandhar", "amritsar",
    "ludhiana", "shimla", "jammu", "srinagar", "raipur",
    "guwahati", "imphal", "shillong", "gangtok",
    "pondicherry", "puducherry", "madurai", "tiruchirappalli",
    "trichy", "salem", "tiruppur", "erode", "vellore",
    "guntur", "warangal", "nellore", "vijayawada",
    "thane", "navi mumbai", "kalyan", "vasai", "panvel",
    "mohali", "panchkula", "greater noida",
    "ncr", "delhi ncr", "delhi-ncr", "new delhi",
    "india", "pan india", "pan-india", "across india", "multiple cities india",
    "remote", "work from home", "wfh", "hybrid",
    "maharashtra", "karnataka", "tamil nadu", "telangana",
    "andhra pradesh", "west bengal", "rajasthan", "gujarat",
    "uttar pradesh", "madhya pradesh", "kerala", "punjab",
    "haryana", "bihar", "odisha", "jharkhand", "chhattisgarh",
    "uttarakhand", "goa", "assam",
]
OUTSIDE_PLACES = [
    "new york", "san francisco", "los angeles", "chicago", "boston",
    "seattle", "austin", "denver", "dallas", "houston", "miami",
    "atlanta", "philadelphia", "washington dc", "washington, dc",
    "baltimore", "bethesda", "arlington",
    "san jose", "san diego", "portland", "phoenix", "minneapolis",
    "detroit", "charlotte", "nashville", "raleigh", "st louis",
    "st. louis", "santa monica", "bellevue", "palo alto",
    "mountain view", "cupertino", "redmond", "irvine",
    "salt lake", "pittsburgh", "kansas city", "indianapolis",
    "columbus", "cleveland", "tampa", "orlando", "sacramento",
    "california", "texas", "florida", "illinois", "massachusetts",
    "virginia", "maryland", "colorado", "georgia", "ohio",
    "pennsylvania", "new jersey", "connecticut", "oregon",
    "missouri", "tennessee", "north carolina", "south carolina",
    "michigan", "wisconsin", "minnesota", "arizona", "washington",
    "usa", "united states", "us",
    "london", "manchester", "birmingham", "leeds", "glasgow",
    "edinburgh", "bristol", "liverpool", "cambridge", "oxford",
    "uk", "united kingdom", "england", "scotland",
    "berlin", "munich", "hamburg", "frankfurt", "paris", "lyon",
    "amsterdam", "rotterdam", "dublin", "zurich", "geneva",
    "stockholm", "oslo", "copenhagen", "helsinki", "vienna",
    "prague", "warsaw", "barcelona", "madrid", "lisbon", "milan",
    "rome", "brussels", "luxembourg",
    "germany", "france", "netherlands", "switzerland", "spain",
    "italy", "sweden", "norway", "denmark", "finland", "austria",
    "ireland", "belgium", "portugal", "poland", "czech republic",
    "europe",
    "sydney", "melbourne", "brisbane", "perth", "adelaide",
    "auckland", "wellington",
    "australia", "new zealand",
    "dubai", "abu dhabi", "riyadh", "jeddah", "doha", "muscat",
    "kuwait city", "bahrain", "manama",
    "uae", "saudi arabia", "qatar", "oman", "kuwait",
    "singapore", "hong kong", "tokyo", "shanghai", "beijing",
    "seoul", "taipei", "kuala lumpur", "bangkok", "jakarta",
    "manila", "ho chi minh", "hanoi",
    "japan", "china", "south korea", "taiwan", "malaysia",
    "thailand", "indonesia", "philippines", "vietnam",
    "toronto", "vancouver", "montreal", "ottawa", "calgary",
    "canada",
    "johannesburg", "cape town", "nairobi", "lagos",
    "sao paulo", "mexico city", "buenos aires",
    "south africa", "kenya", "nigeria", "brazil", "mexico",
    "argentina",
]
# Meta-region used by the query tool's location filter ("india").
META_REGION_TERMS = [
    "india", "bangalore", "bengaluru", "mumbai", "delhi", "new delhi",
    "hyderabad", "chennai", "pune", "kolkata", "noida", "gurgaon",
    "gurugram", "ahmedabad", "jaipur", "kochi", "lucknow", "indore",
    "chandigarh", "bhopal", "coimbatore", "karnataka", "maharashtra",
    "telangana", "tamil nadu", "haryana", "uttar pradesh", "rajasthan",
    "gujarat", "kerala", "goa", "madhya pradesh", "andhra pradesh",
]

# Salary text treated as "no value".
SALARY_NULL_WORDS = [
    "", "nan", "none", "not disclosed", "competitive", "confidential",
    "as per industry", "best in industry", "-",
]
USD_TO_INR = 85
SALARY_MAX_LPA = 500
YEARS_CAP = 35

# Keyword tokeniser stop words.
STOP_WORDS = ["of", "the", "and", "a", "an", "in", "at", "for", "to", "or", "with"]

# Action verbs for key-phrase extraction.
ACTION_VERBS = [
    "lead", "manage", "drive", "develop", "build", "own",
    "create", "scale", "grow", "oversee", "define", "execute",
    "launch", "optimize", "implement", "design", "establish",
    "mentor", "hire", "collaborate", "partner", "transform",
]

# Company-name cleanup: removed anywhere in the name, in this order.
COMPANY_SUFFIXES = [
    " pvt ltd", " pvt. ltd.", " private limited", " limited",
    " ltd", " ltd.", " inc", " inc.", " corp", " corp.",
    " llp", " llc", " co.", " technologies", " tech",
    " solutions", " services", " consulting", " group",
    " india", " global",
]
DOMAIN_TLDS = [".com", ".in", ".co.in", ".io"]

# Hiring-role categories (multi-label, lexicon order breaks ties).
ROLE_CATEGORIES = [
    ("Marketing", ["marketing", "brand", "growth", "digital marketing",
                   "content", "seo", "social media", "performance marketing",
                   "demand generation", "product marketing", "cmo"]),
    ("Sales", ["sales", "business development", "account executive",
               "account manager", "revenue", "partnerships"]),
    ("Engineering", ["engineer", "developer", "software", "frontend", "backend",
                     "full stack", "fullstack", "devops", "sre", "cto", "tech lead",
                     "data engineer", "ml engineer", "platform"]),
    ("Product", ["product manager", "product owner", "product lead",
                 "product director", "head of product", "vp product"]),
    ("Design", ["designer", "ux", "ui", "creative director",
                "design lead", "visual design", "graphic design"]),
    ("Data", ["data scientist", "data analyst", "analytics",
              "business analyst", "business intelligence", "bi "]),
    ("HR", ["hr ", "human resources", "talent acquisition",
            "recruiter", "people operations", "people partner"]),
    ("Finance", ["finance", "accounting", "cfo", "controller",
                 "financial analyst", "fp&a"]),
    ("Operations", ["operations", "supply chain", "logistics", "coo",
                    "project manager", "program manager"]),
]

# Consultant type (single best label).
CONSULTANT_TYPES = [
    ("Executive Search", ["executive search", "c-suite", "c-level", "board",
                          "korn ferry", "egon zehnder", "spencer stuart",
                          "heidrick", "boyden", "hunt partners"]),
    ("Agency Recruiter", ["recruitment consultant", "recruiter", "recruiting",
                          "talent acquisition", "staffing", "placement",
                          "headhunter", "headhunt", "search consultant"]),
    ("Staffing Firm", ["staffing", "manpower", "workforce", "contract staffing",
                       "temp staffing", "temporary", "outsourcing",
                       "randstad", "adecco", "teamlease", "quess", "kelly"]),
    ("HR Consultancy", ["hr consulting", "hr solutions", "hr consultancy",
                        "people solutions", "human capital", "hr advisory"]),
    ("Recruitment Partner", ["recruitment partner", "talent partner", "rpo",
                             "recruitment process outsourcing", "embedded recruiter"]),
]

# Agency signal terms (any hit → agency).
AGENCY_SIGNALS = [
    "staffing", "recruitment", "recruiting", "manpower",
    "placement", "hr solutions", "people solutions",
    "workforce solutions", "headhunt",
    "human capital", "personnel services", "job placement",
    "executive search", "talent solutions", "talent consulting",
    "talent corner", "talent partner",
    "randstad", "adecco", "robert half", "michael page",
    "hays ", "teamlease", "abc consultants", "quess",
    "kelly services", "ciel hr", "hunt partners", "korn ferry",
    "egon zehnder", "spencer stuart", "heidrick", "boyden",
    "genius consultants", "mancer consulting",
    "xpheno", "careernet", "taggd",
    "naukri hiring", "foundit hiring",
    "persolkelly", "gi group", "manpowergroup",
    "hudson", "page group", "pagegroup",
    "antal", "collabera", "nri consulting",
]

# HR department terms for candidate preference.
HR_TERMS = [
    "hr", "human resources", "talent", "recruiting", "recruitment",
    "people", "ta ", "talent acquisition", "hiring", "staffing",
    "head of people", "chro", "hrbp", "people ops",
]

# Shortlist thresholds.
SHORTLIST_MAX_MIN_YEARS = 10
SHORTLIST_MIN_SALARY = 27
SHORTLIST_TITLE_TERM = "marketing"


@dataclass(frozen=True)
class Profile:
    """All tunable data of the listing pipeline."""

    b2b: tuple = tuple(B2B_TERMS)
    b2c: tuple = tuple(B2C_TERMS)
    d2c: tuple = tuple(D2C_TERMS)
    role_title_rules: tuple = tuple((lbl, tuple(t)) for lbl, t in ROLE_TITLE_RULES)
    tier1: tuple = tuple(TIER1_CITIES)
    home: tuple = tuple(HOME_SIGNALS)
    home_word: str = "india"
    foreign: tuple = tuple(FOREIGN_SIGNALS)
    title_strong: tuple = tuple(TITLE_STRONG)
    title_good: tuple = tuple(TITLE_GOOD)
    title_weak: tuple = tuple(TITLE_WEAK)
    seniority: tuple = tuple((p, tuple(t)) for p, t in SENIORITY_TIERS)
    remote_terms: tuple = tuple(REMOTE_TERMS)
    remote_terms_wide: tuple = tuple(REMOTE_TERMS_WIDE)
    inside: tuple = tuple(INSIDE_PLACES)
    outside: tuple = tuple(OUTSIDE_PLACES)
    meta_region: tuple = tuple(META_REGION_TERMS)
    action_verbs: tuple = tuple(ACTION_VERBS)
    stop_words: tuple = tuple(STOP_WORDS)
    # relevance weights
    w_title: tuple = (30, 20, 10, 0)
    w_years: tuple = (15, 10, 5, 0, 8)        # 8-12, 5-15, <=20, >20, unknown
    w_salary: tuple = (15, 12, 8, 3, 8)       # >40, >27, >15, else, unknown
    salary_cuts: tuple = (40, 27, 15)
    w_location: tuple = (10, 7, 6, 3, 5)      # tier1, home word, remote, other, blank
    w_foreign: int = -40
    w_unknown_place: int = -15
    w_company: tuple = (10, 8, 6, 4)          # b2c/d2c, b2b, mixed, other
    w_fresh: tuple = (5, 2)

    def with_(self, **kw) -> "Profile":
        return replace(self, **kw)


JOBS = Profile()
