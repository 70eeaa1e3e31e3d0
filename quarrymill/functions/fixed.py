"""Word lists, patterns and weights that results depend on.  None of them is logic.

Patterns are case-insensitive and hold no look-around, so any engine can run them.
"""

# fixed values: industry profiles in their order: label, aliases, keywords, words of another industry
INDUSTRIES = {
    "hospitality": (
        "Hospitality",
        ["hotels", "hotel", "lodging", "tourism", "travel", "restaurant"],
        r"\b(hotel|resort|hospitality|lodging|motel|inn\b|restaurant|dining|catering|banquet|spa\b|casino|travel|tourism|airline|cruise|hostel|bed and breakfast|b&b|food service|accommodation)\b",
        r"\b(bank|banking|financial services|insurance|petroleum|oil and gas|oilfield|mining|investment bank|credit union|mortgage|lending)\b",
    ),
    "healthcare": (
        "Healthcare",
        ["health", "medical", "pharma", "pharmaceutical", "biotech", "healthtech", "medtech"],
        r"\b(healthcare|health care|healthtech|health tech|digital health|hospital|clinic|medical|physician|pharma|pharmaceutical|biotech|life sciences|diagnostic|patient|nursing|dental|telehealth|medtech)\b",
        r"\b(bank|oil and gas|petroleum|mining|hospitality|hotel|restaurant|casino)\b",
    ),
    "technology": (
        "Technology",
        ["tech", "software", "saas", "it", "information technology"],
        r"\b(software|saas|software company|technology company|tech startup|tech company|cloud platform|cloud software|cybersecurity|devops|artificial intelligence|\bai\b|machine learning|data platform|it services|developer tools|enterprise software|b2b software|software platform|api platform|\btech\b|\btechnology\b)\b",
        r"\b(bank\b|insurance carrier|oil and gas|petroleum refinery|mining company|hotel chain|restaurant chain|magazine|publisher|publishing|newspaper|media group|broadcasting|television network|entertainment company|retail chain|supermarket chain|conglomerate|holding company|fortune 500 list|business media|news organization|hardware|semiconductor|telecom|telecommunications|mobile operator|wireless carrier|network equipment|chip maker|foundry)\b",
    ),
    "finance": (
        "Finance",
        ["banking", "financial", "fintech", "insurance"],
        r"\b(bank|banking|financial services|investment|asset management|wealth management|insurance|fintech|credit union|capital markets|private equity|venture capital|lending|mortgage)\b",
        r"\b(hotel|resort|restaurant|hospitality|petroleum|oilfield|mining|hospital|clinic)\b",
    ),
    "oil_gas": (
        "Oil & Gas",
        ["energy", "petroleum", "oil", "gas"],
        r"\b(oil and gas|petroleum|oilfield|upstream|downstream|refinery|drilling|energy company|natural gas|lng\b|pipeline|offshore rig)\b",
        r"\b(bank|hotel|restaurant|hospitality|hospital|software company|saas)\b",
    ),
    "retail": (
        "Retail",
        ["ecommerce", "e-commerce", "consumer"],
        r"\b(retail|ecommerce|e-commerce|consumer goods|fashion|apparel|grocery|supermarket|merchandise|store chain|marketplace)\b",
        r"\b(bank|investment bank|private equity|venture capital|accelerator|incubator|oil and gas|petroleum|hospital)\b",
    ),
    "manufacturing": (
        "Manufacturing",
        ["industrial", "factory"],
        r"\b(manufacturing|industrial|factory|production plant|assembly|machinery|automotive|aerospace|semiconductor|fabrication)\b",
        r"\b(bank|hotel|restaurant|hospital|software-only)\b",
    ),
    "real_estate": ("Real Estate", ["property", "proptech"], r"\b(real estate|property management|proptech|commercial real estate|reit\b|landlord|leasing|brokerage)\b", r"\b(bank|oil and gas|hospital|software saas)\b"),
    "media": (
        "Media & Entertainment",
        ["media", "entertainment", "streaming", "gaming", "film", "publishing", "broadcast"],
        r"\b(media|entertainment|streaming|broadcast|broadcasting|television|tv network|film|movie|production studio|production company|gaming|game studio|publisher|publishing|newsroom|magazine|ott\b|video platform|content studio|music label|theatre|theater)\b",
        r"\b(bank|oil and gas|petroleum|mining company|insurance carrier)\b",
    ),
}
HEALTH_SOFTWARE = r"\b(healthtech|health tech|digital health|medtech|telehealth|patient|clinical|medical software|healthcare software|health platform)\b"

# fixed values: company types in the order of the cascade, each with its pattern and label
ACCELERATOR_DOMAINS = ["ycombinator.com", "techstars.com", "500.co", "plugandplaytechcenter.com", "seedcamp.com"]
INVESTMENT_DOMAINS = ["verdane.com", "eqtgroup.com", "kinnevik.com", "norrsken.org", "sequoiacap.com", "a16z.com", "accel.com"]
ACCELERATOR_NAMES = r"\b(y combinator|techstars|500 global|500 startups|plug and play|startupbootcamp|masschallenge|antler\b|era\b accelerator|seedcamp)\b"
INVESTMENT_FIRMS = r"\b(private equity|growth equity|buyout firm|investment firm|investment company|asset manager|venture fund|capital partners|growth investor|verdane|eqt\b|kinnevik|norrsken)\b"
ACCELERATORS = r"\b(startup accelerator|accelerator program|business incubator|startup incubator|incubator program|accelerator\b)\b"
VENTURE = r"\b(venture capital|\bvc\b|seed fund|early[- ]stage fund|angel fund)\b"
HAS_PRODUCT = r"\b(software company|saas|our product)\b"
COMPANY_TYPES = [
    ("news_media", r"\b(newsroom|newspaper|magazine|publisher|publishing|journalism|media group|broadcasting)\b"),
    ("community", r"\b(community platform|membership community|professional network|forum for|nonprofit community)\b"),
    ("ecommerce", r"\b(ecommerce|e-commerce|online store|online shop|webshop|direct[- ]to[- ]consumer|dtc brand|retail brand|fashion brand|sell(s|ing) online|checkout|shopping cart|shopify store)\b"),
    ("marketplace", r"\b(marketplace|two-sided platform|buyers and sellers|vendor platform|multi-vendor)\b"),
    ("saas", r"\b(saas|software as a service|subscription software|cloud software|software platform)\b"),
    ("fintech", r"\b(fintech|payment(s)? platform|digital bank|neobank|lending platform|insurtech)\b"),
    ("agency", r"\b(digital agency|creative agency|consulting firm|professional services|dev shop|development agency)\b"),
    ("service_provider", r"\b(outsourcing|staff augmentation|it services provider)\b"),
]
TYPE_LABELS = {"saas": "SaaS", "ecommerce": "E-commerce", "marketplace": "Marketplace", "fintech": "FinTech", "agency": "Agency", "vc": "Venture capital", "accelerator": "Accelerator", "investment_firm": "Investment firm", "news_media": "News / media", "community": "Community", "service_provider": "Service provider", "operating_company": "Operating company", "unknown": "Unknown"}

# fixed values: title relevance, the first pattern that fits counts
TITLE_SCORES = [
    (r"\b(co[- ]?founder|cofounder)\b", 100),
    (r"\bfounder\b", 98),
    (r"\bceo\b|chief executive", 96),
    (r"\bcto\b|chief technology", 92),
    (r"\bcfo\b|chief financial", 90),
    (r"\bcoo\b|chief operating", 88),
    (r"\bchief\b", 86),
    (r"\bvp\b|vice president", 84),
    (r"\bpresident\b", 82),
    (r"\bdirector\b", 78),
    (r"\bhead of\b", 76),
    (r"\bmanager\b", 70),
    (r"\blead\b", 65),
    (r"\bpartner\b", 62),
]
DEPARTMENTS = [
    (r"\b(engineering|software|developer|technology|tech|it)\b", "Engineering"),
    (r"\b(sales|revenue|business development|bd)\b", "Sales"),
    (r"\b(marketing|growth|brand|content)\b", "Marketing"),
    (r"\b(product)\b", "Product"),
    (r"\b(finance|financial|accounting)\b", "Finance"),
    (r"\b(hr|human resources|people|talent)\b", "Human Resources"),
    (r"\b(operations|ops)\b", "Operations"),
    (r"\b(legal|counsel)\b", "Legal"),
    (r"\b(customer success|support|service)\b", "Customer Success"),
    (r"\b(design|creative|ux|ui)\b", "Design"),
    (r"\b(data|analytics|science)\b", "Data"),
    (r"\b(security|cyber)\b", "Security"),
]

# fixed values: intent rules in their order: id, strength, pattern; and points of a strength
INTENT_RULES = [
    ("buying_language", "high", r"\b(evaluating|looking for|seeking|in the market for|vendor selection|rfp|request for proposal|shortlist|procurement)\b"),
    ("funding", "high", r"\b(raised|funding round|series [a-e]|venture capital|seed round|investment from|secured \$)\b"),
    ("digital_initiative", "high", r"\b(digital transformation|moderniz(e|ing)|cloud migration|automation initiative|platform upgrade)\b"),
    ("hiring", "medium", r"\b(we(?:'re| are) hiring|job openings?|open roles?|join our team|careers page|growing team)\b"),
    ("expansion", "medium", r"\b(expanding|new office|international growth|scaling|rapid growth|market expansion)\b"),
    ("tech_adoption", "medium", r"\b(implementing|rolling out|adopting|deploying|migrating to|new software|new platform)\b"),
    ("pain_point", "medium", r"\b(challenge|pain point|struggling with|need to improve|looking to streamline|inefficien)\b"),
]
INTENT_POINTS = {"high": 35, "medium": 20, "low": 10}

# fixed values: hosts that are nobody's company site
BLOCKED_HOSTS = ["google.com", "www.google.com", "bing.com", "www.bing.com", "duckduckgo.com", "www.duckduckgo.com", "facebook.com", "www.facebook.com", "linkedin.com", "www.linkedin.com", "twitter.com", "x.com", "youtube.com", "wikipedia.org", "amazon.com"]

# fixed values: addresses that stand for no real one
PLACEHOLDER_EMAILS = [r"example\.com$", r"test\.com$", r"domain\.com$", r"yourcompany\.com$", r"company\.com$", r"email@", r"name@", r"user@", r"@sentry\.", r"\.png$", r"\.jpg$", r"^xxx@", r"^sample@"]
EMAIL_SYNTAX = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
DOMAIN_SYNTAX = r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"

# fixed values: technologies by what their pages hold
TECHNOLOGY_SIGNS = {
    "React": r"react(\.min)?\.js|__NEXT_DATA__|_next/static",
    "Next.js": r"_next/static|__NEXT_DATA__",
    "Vue": r"vue(\.min)?\.js",
    "Angular": r"angular(\.min)?\.js|ng-version",
    "WordPress": r"wp-content|wordpress",
    "Shopify": r"cdn\.shopify\.com|shopify",
    "HubSpot": r"js\.hs-scripts\.com|hubspot",
    "Node.js": r"node\.js|express",
    "AWS": r"amazonaws\.com",
    "Azure": r"azure",
    "PostgreSQL": r"postgresql",
    "Docker": r"docker",
}

# fixed values: bands of head counts
EMPLOYEE_BANDS = [(10, "1 – 10"), (50, "11 – 50"), (200, "51 – 200"), (500, "201 – 500"), (1000, "501 – 1,000"), (5000, "1,001 – 5,000")]

# fixed values: weights of the six lead factors, and of the five parts of a profile's confidence
LEAD_WEIGHTS = {"industry": 18, "type": 18, "size": 16, "location": 16, "role": 16, "technology": 16}

# fixed values: what else stands for a keyword of a search, and keywords that belong together
KEYWORD_SYNONYMS = {
    "b2b": ["b2b", "business to business", "business-to-business", "enterprise", "saas"],
    "software": ["software", "saas", "application", "platform", "it services", "technology"],
    "saas": ["saas", "software as a service", "cloud software", "subscription"],
    "startup": ["startup", "start-up", "scale-up"],
    "tech": ["tech", "technology"],
    "healthtech": ["healthtech", "health tech", "digital health", "healthcare", "health care", "medtech", "medical", "telehealth"],
    "healthcare": ["healthcare", "health care", "healthtech", "health tech", "digital health", "medtech", "medical", "patient"],
    "medical": ["medical", "healthcare", "health care", "healthtech", "clinic", "hospital"],
}
HEALTH_CLUSTER = r"\b(healthtech|health tech|healthcare|health care|digital health|medtech|medical|telehealth|patient|clinical)\b"
SOFTWARE_KEYWORDS = ["software", "saas", "cloud software", "b2b software"]

# fixed values: paths of a site where people stand, then those of contact pages; and what a link to such a page says
LEADERSHIP_PATHS = [
    "/about", "/about-us", "/about/team", "/about/leadership", "/about/management", "/about/our-team", "/about/our-leadership", "/team", "/our-team", "/leadership", "/management", "/staff",
    "/department/key-management", "/key-management", "/people", "/our-people", "/board", "/board-of-directors", "/board-of-management", "/directors", "/executives", "/executive-team", "/senior-management",
    "/senior-leadership", "/governance", "/who-we-are", "/about-us/our-story", "/company/about", "/company/about-us", "/who-we-are/team", "/who-we-are/leadership", "/our-company", "/our-company/leadership",
    "/company/team", "/company/leadership", "/company/management", "/about-us/team", "/about-us/leadership", "/about-us/management", "/investors/leadership", "/investors/management", "/om-oss", "/om-oss/team",
    "/ledning", "/vara-team", "/medarbetare", "/organisation",
]
CONTACT_PATHS = ["/contact", "/contact-us"]
DIRECTORY_LINK = r"(team|people|staff|leadership|management|key-management|board|director|executive|governance|our-people|senior|about-us|about|who-we-are|awards|news|press|speakers|events|blog|announcements)"
