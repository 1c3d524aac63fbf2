"""Word lists, patterns and constants of the posting rules.

All of it is fixed values: results are right only if they are these. Patterns run
unchanged in Java's and RE2's dialect, so each serves Spark and the SQL oracle.
"""

from __future__ import annotations

# Enumerations.
REGIONS = ("worldwide", "us", "canada", "emea", "europe", "apac", "india", "latam", "unknown")
BLOCKING_REGIONS = ("us", "canada", "emea", "europe", "latam")
ALLOWED_REGIONS = ("worldwide", "india")
EMPLOYMENT_ALLOWED = ("internship", "full_time", "unknown")

# Experience, in full text or title.
YOE_RANGE = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:-|–|to)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
YOE_MIN = r"(?i)(?:at\s+least|minimum\s+(?:of\s+)?|min\.?\s*|over\s+)?(\d{1,2})\s*\+\s*(?:years?|yrs?)"
YOE_PLAIN = r"(?i)(\d{1,2})\s*(?:years?|yrs?)\s+(?:of\s+)?(?:relevant\s+)?experience"
NEW_GRAD = r"(?i)\b(new\s*grad(uate)?s?|recent\s+graduate|entry[\s-]?level|fresher|campus\s+hire|university\s+grad|graduate\s+program(me)?|no\s+experience\s+required|0\s*[-–to]*\s*1\s*years?)\b"
INTERN = r"(?i)\b(interns?|internships?|co-?ops?|summer\s+20\d\d|winter\s+20\d\d|fall\s+20\d\d|spring\s+20\d\d|trainees?|apprentices?|fellows?|fellowships?|student\s+(?:interns?|developer|worker))\b"
STRONG_SENIORITY = r"(?i)\b(senior|sr\.?|staff|principal|lead|director|head\s+of|vp|cto|architect|distinguished|fellow|manager|vice\s+president|avp|svp|evp|managing\s+director|executive\s+director)\b"
JUNIOR_TITLE = r"(?i)(\b(junior|jr\.?|graduate|grad|campus|university|early\s*career|entry[\s-]?level|trainee|apprentice|fresher|rotational)\b|\b(associate)\s+(software|data|ai|ml|backend|frontend|full|engineer|developer|scientist|analyst)|\b(engineer|developer|scientist|analyst|programmer)\s*(-|–|,)?\s*(i|1)\b|\b(i|1)\s*$)"
SENIORITY = r"(?i)(\bsenior\b|\bsr\.?\b|\bstaff\b|\bprincipal\b|\blead\b|\bmanager\b|\bhead\s+of\b|\bdirector\b|\barchitect\b|\bcto\b|\bvp\b|\b(ii|iii|iv)\b|\b[2-9]\s*$)"

# Graduation years.
GRAD_YEAR = r"202[4-9]"
GRAD_PATTERNS = (
    r"(?i)\b(?:class\s+of|batch\s+of|batch|passing\s+out(?:\s+in)?|graduat(?:ing|e|ion|es)?|expected\s+grad(?:uation)?|target\s+grad(?:uation)?|degree\s+completion|graduation\s+date)\b[^\n.]{0,100}?((?:202[4-9])(?:\s*(?:,|/|-|–|or|and|to|&)\s*(?:(?:spring|summer|fall|winter|dec(?:ember)?|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?)\s+)?202[4-9])*)",
    r"(?i)\b((?:202[4-9])(?:\s*(?:,|/|-|–|or|and|to|&)\s*202[4-9])*)\s*(?:batch|passouts?|pass\s*outs?|graduates?|grads?)\b",
    r"(?i)\b(?:summer|winter|fall|spring)\s+(202[4-9])\b",
    r"(?i)\b(?:interns?|internships?|trainees?|graduates?|new\s*grads?|fresher)\s*[-–/:]?\s*(?:[a-z/]+\s+){0,2}(202[4-9])\b",
    r"(?i)\b(202[4-9])\s*[-–/:]?\s*(?:[a-z/]+\s+){0,2}(?:interns?|internships?|trainees?|graduates?|new\s*grads?|fresher)\b",
)

# Degree, eligibility, pay.
ADVANCED_DEGREE = r"(?i)(\b(ph\.?\s?d|doctoral|doctorate|post[\s-]?doc\w*)\b|\b(?:m\.?s\.?|m\.?tech|m\.?e\.?|master(?:'?s)?)\s+(?:degree\s+)?(?:is\s+)?(?:required|mandatory|must|only)\b|\b(?:currently\s+)?(?:pursuing|enrolled\s+in)\s+(?:an?\s+)?(?:m\.?s\.?|m\.?tech|master(?:'?s)?|ph\.?\s?d|doctoral)\b)"
BACHELOR_OK = r"(?i)\b(bachelor(?:'?s)?|b\.?\s?tech|b\.?\s?e\.?\b|b\.?\s?s\.?c?\b|bs\b|undergraduate|under[\s-]?grad|final[\s-]?year|pre[\s-]?final)\b"
US_ONLY = r"(?i)(enrolled\s+(?:in|at)\s+(?:an?\s+)?(?:accredited\s+)?(?:us|u\.s\.|american)\s+(?:university|college|institution)|(?:us|u\.s\.)\s+citizen(?:ship)?\s*(?:is\s*)?(?:required|only)|must\s+be\s+(?:a\s+)?(?:us|u\.s\.)\s+citizen|(?:authorized|authorised|eligible)\s+to\s+work\s+in\s+the\s+(?:us|u\.s\.|united\s+states)\s*(?:without\s+sponsorship)?|work\s+authorization\s+in\s+the\s+(?:us|united\s+states))"
UNPAID = r"(?i)\b(unpaid|no\s+stipend|without\s+stipend|stipend\s*[:\-]?\s*(?:none|nil|0|unpaid))\b"
PAY_MONTHLY = r"(?i)(?:₹|rs\.?|inr|usd|\$)\s*([\d][\d,.]{2,12})\s*(?:-|–|to)?\s*(?:(?:₹|rs\.?|inr|usd|\$)?\s*([\d][\d,.]{2,12}))?\s*(?:/|per\s+|a\s+)?\s*(?:month|mo\b|pm\b|monthly)"
PAY_LPA = r"(?i)(\d{1,3}(?:\.\d{1,2})?)\s*(?:-|–|to)?\s*(\d{1,3}(?:\.\d{1,2})?)?\s*(?:lpa|lakhs?\s*(?:per\s+annum|p\.?a\.?)?|l\.?p\.?a)"
PAY_ANNUAL = r"(?i)(?:₹|rs\.?|inr|usd|\$)\s*([\d][\d,.]{2,12})\s*(?:-|–|to)?\s*(?:(?:₹|rs\.?|inr|usd|\$)?\s*([\d][\d,.]{2,12}))?\s*(?:/|per\s+|a\s+)?\s*(?:year|annum|yr\b|pa\b|annually)"
PAY_NEAR = r"(?i)stipend|salary|compensation|ctc|pay\b"

# Work authorization, sponsorship, place.
SPONSORS = r"(?i)(visa\s+sponsorship\s+(is\s+)?(available|provided|offered)|(we|company)\s+(can\s+|will\s+)?sponsor(s|ship)?\s+(visa|work\s+permit|employment\s+visa|h-?1b)|sponsor\s+(your\s+)?(visa|work\s+permit)|visa\s+(and\s+relocation\s+)?support\s+(is\s+)?(available|provided)|we\s+sponsor\s+visas|eligible\s+for\s+visa\s+sponsorship|work\s+permit\s+sponsorship)"
WORK_AUTH = r"(?i)(must\s+be\s+(legally\s+)?authoriz|authorized\s+to\s+work|work\s+authorization|no\s+visa\s+sponsorship|cannot\s+sponsor|unable\s+to\s+sponsor|not\s+able\s+to\s+sponsor|eligible\s+to\s+work\s+in\s+the\s+(us|united\s+states))"
NO_SPONSOR = r"(?i)(no\s+visa\s+sponsorship|cannot\s+sponsor|unable\s+to\s+sponsor)"
RELOCATION = r"(?i)relocation\s+(package|assistance|support|benefits?)"
WORLDWIDE = r"(?i)\b(worldwide|anywhere|global|work\s+from\s+anywhere|hire\s+(?:from\s+)?anywhere|anywhere\s+in\s+the\s+world|fully\s+remote\s+worldwide|remote\s*[-–—/:,(]?\s*(?:worldwide|global|anywhere|international|all\s+locations)|(?:worldwide|global|anywhere)\s*[-–—/:,(]?\s*remote|100%\s+remote\s*(?:worldwide|global|anywhere)?|remote\s*[-–—/]\s*(?:us|usa|europe|emea|apac|latam|india|\w+)?\s*(?:and|or|/|,)\s*(?:worldwide|global|international|anywhere))\b"
US_REMOTE = r"(?i)\bremote\s*\(?\s*(us|usa|united\s+states)\b"
REMOTE = r"(?i)\b(remote|anywhere|worldwide|global|distributed|work\s+from\s+home|wfh)\b"
ONSITE = r"(?i)\b(on-?site|in-?office|hybrid)\b"
#: In lower case, one of these is in every text in which the pattern of the same name finds something.
REMOTE_HINTS = ("remote", "anywhere", "worldwide", "global", "distributed", "work", "wfh")
ONSITE_HINTS = ("site", "office", "hybrid")
GERMAN = r"(?i)(wir\s+(suchen|sind|bieten)|deine\s+aufgaben|dein\s+profil|unser\s+team|das\s+bieten\s+wir|berufserfahrung|abgeschlossenes\s+studium|m/w/d|w/m/d|\(m/w)"
CITIES = (
    ("india", r"(?i)\b(bangalore|bengaluru|hyderabad|pune|chennai|mumbai|new\s+delhi|delhi|gurgaon|gurugram|noida|kolkata|ahmedabad|jaipur|kochi|coimbatore|indore|india)\b"),
    ("europe", r"(?i)\b(m(ü|u)nchen|munich|berlin|hamburg|frankfurt|stuttgart|cologne|k(ö|o)ln|chemnitz|leipzig|dresden|bad\s+homburg|amsterdam|rotterdam|paris|lyon|madrid|barcelona|lisbon|warsaw|krak(ó|o)w|prague|vienna|zurich|z(ü|u)rich|geneva|stockholm|copenhagen|oslo|helsinki|dublin|brussels|milan|rome|london|manchester|edinburgh|germany|deutschland|netherlands|france|spain|poland|portugal|belgium|italy|sweden|denmark|norway|finland|ireland|austria|switzerland|united\s+kingdom)\b"),
    ("us", r"(?i)\b(san\s+francisco|new\s+york|nyc|seattle|austin|boston|chicago|denver|atlanta|los\s+angeles|san\s+diego|portland|palo\s+alto|mountain\s+view|irvine|brooklyn|united\s+states|usa)\b"),
    ("canada", r"(?i)\b(toronto|vancouver|montreal|canada)\b"),
    ("apac", r"(?i)\b(singapore|tokyo|seoul|sydney|melbourne|hong\s+kong|japan|australia)\b"),
    ("emea", r"(?i)\b(dubai|abu\s+dhabi|uae|emirates|riyadh|saudi|qatar|doha)\b"),
)
EMPLOYMENT_EXCLUDED = (
    r"\bfreelance\b", r"\bcontractor\b", r"\bpart[\s-]?time\b", r"\bwerkstudent\b", r"\bworking\s+student\b",
    r"\bpraktikum\b", r"\bmaster\s+thesis\b", r"\bthesis\b", r"\bvolunteer\b",
)

# Roles by words of the title, in the order in which they are tried.
ROLE_WORDS = (
    ("fullstack", ("full stack", "fullstack", "full-stack", "mern", "mean stack")),
    ("ml", (
        "ai engineer", "machine learning", "ml engineer", "deep learning", "nlp engineer", "llm engineer", "genai", "generative ai",
        "ai developer", "ai/ml", "ai ml", "applied scientist", "ai full stack", "agent engineer", "ai intern", "artificial intelligence",
        "ml intern", "computer vision", "vision engineer", "ai research engineer", "intern - ai", "intern - ml",
    )),
    ("data", (
        "data engineer", "data scientist", "analytics engineer", "data analyst", "bi developer", "business intelligence", "data science",
        "data analytics", "analytics intern", "data intern", "intern - data", "intern - analytics",
    )),
    ("frontend", (
        "frontend", "front-end", "front end", "ui engineer", "react developer", "react.js", "next.js developer", "web developer",
        "ui intern", "intern - ui",
    )),
    ("backend", (
        "backend", "back-end", "back end", "api engineer", "server engineer", "node.js developer", "python developer", "python intern",
        "java intern", "intern - python", "intern - java",
    )),
    ("swe", (
        "software engineer", "software developer", "sde", "swe", "programmer", "application developer", "product engineer",
        "software development", "application engineer", "applications engineer", "developer intern", "engineering intern",
        "technology intern", "tech intern", "it intern", "technical intern", "application development intern", "software intern",
        "web development intern", "app development intern", "research engineer intern", "summer intern", "winter intern", "campus intern",
        "student intern", "student developer", "graduate intern", "graduate engineer trainee", "graduate trainee", "trainee engineer",
        "forward deployed engineer", "software trainee", "developer trainee", "trainee developer", "fresher developer",
        "technology analyst", "software apprentice", "founding engineer", "member of technical staff", "engineering trainee",
        "app developer", "mobile developer", "react native", "flutter developer", "android developer", "ios developer",
        "intern - software", "intern - development", "intern - engineering", "intern - tech", "intern - web", "intern - mobile",
        "qa intern", "sdet intern",
    )),
)
ROLE_EXCLUDED = (
    "sales engineer", "solutions engineer", "support engineer", "customer engineer", "service desk", "systemadministrator",
    "system administrator", "technical writer", "recruiter", "qa manual", "business analyst", "product tester", "reader-tester",
    "product manager", "project manager", "designer", "kommunikationsdesign", "robotics", "hardware engineer", "embedded", "firmware",
    "mechanical", "electrical", "accountant", "marketing", "medical", "civil engineering", "sourcing", "tech support", "helpdesk",
    "help desk", "gadget", "market development", "business development", "copywriter", "writer", "teacher", "tutor",
)
INTERN_ROLES = (
    ("frontend", r"\b(frontend|ui|front[\s-]end)\b"),
    ("backend", r"\b(backend|back[\s-]end|api)\b"),
    ("fullstack", r"\b(full[\s-]?stack|mern)\b"),
    ("ml", r"\b(ai|ml|machine\s+learning|deep\s+learning|computer\s+vision|nlp|genai)\b"),
    ("data", r"\b(data\s+science|data\s+analyst|data\s+engineering|analytics)\b"),
    ("swe", r"\b(tech\w*|engineering|software|developer|dev|sde|swe|coding|programming|web|frontend|backend|full\s*stack|ai|ml|data|cloud|mobile|qa|sdet|systems?|it|analytics|algorithm)\b"),
)
#: A generic intern's role by the skills around: the first row of which a skill is there.
SKILL_ROLES = (
    ("ml", ("pytorch", "tensorflow", "scikit-learn", "llm", "nlp", "ai agents", "generative ai", "rag")),
    ("data", ("pandas", "numpy", "spark", "airflow", "snowflake", "databricks", "power bi")),
    ("frontend", ("react", "next.js", "vue", "angular", "tailwind", "redux")),
    ("backend", ("node.js", "express", "django", "fastapi", "flask", "spring", "golang", "go")),
)
FULLSTACK_SERVERS = ("node.js", "express", "django", "fastapi", "spring", "postgres", "mongodb")

# Skills and the profile's stack.
SKILLS = (
    "python", "java", "javascript", "typescript", "go", "golang", "rust", "c++", "c#", "ruby", "php", "kotlin", "swift", "scala",
    "elixir", "sql", "react", "next.js", "vue", "angular", "svelte", "tailwind", "redux", "node.js", "express", "django", "flask",
    "fastapi", "spring", "rails", "graphql", "rest", "grpc", "postgres", "postgresql", "mysql", "mongodb", "redis", "elasticsearch",
    "kafka", "rabbitmq", "dynamodb", "cassandra", "aws", "gcp", "azure", "docker", "kubernetes", "terraform", "ansible", "jenkins",
    "github actions", "ci/cd", "linux", "pytorch", "tensorflow", "scikit-learn", "pandas", "numpy", "spark", "airflow", "dbt",
    "snowflake", "databricks", "llm", "nlp", "langchain", "langgraph", "socket.io", "firebase", "power bi", "postman", "git", "github",
    "prompt engineering", "ai agents", "generative ai", "genai", "rag", "vector database", "openai", "huggingface", "mern",
    "streamlit", "jupyter", "matplotlib", "selenium", "supabase",
)
ALIASES = (("golang", "go"), ("postgresql", "postgres"))
STRONG = (
    "python", "javascript", "c", "sql", "react", "next.js", "tailwind", "node.js", "express", "fastapi", "rest", "socket.io", "llm",
    "langchain", "langgraph", "prompt engineering", "ai agents", "mongodb", "mysql", "firebase", "git", "docker", "postman", "power bi",
)
LEARNING = ("typescript", "postgres", "aws", "kubernetes", "redis", "graphql")

# Companies.
COMPANY_NOISE = r"(?i)\b(inc|llc|ltd|limited|corp|corporation|gmbh|pvt|private|technologies|technology|labs|software|solutions|services|group|co|company|the|india)\b\.?"
LEGAL_SUFFIX = r"\b(inc|llc|ltd|limited|corp|corporation|gmbh|pvt|private|plc|co|company|the|india)\b\.?"
EXCLUDED_COMPANIES = (
    "jobgether", "randstad", "adecco", "manpower", "teamlease", "quess corp", "randstad digital", "collabera", "hays", "michael page",
    "robert half", "talentpro", "staffing",
)
NOTABLE_COMPANIES = (
    "google", "amazon", "amazon web services", "microsoft", "apple", "meta", "netflix", "nvidia", "adobe", "salesforce", "oracle",
    "intel", "amd", "qualcomm", "cisco", "ibm", "sap", "vmware", "broadcom", "servicenow", "workday", "atlassian", "uber", "linkedin",
    "electronic arts", "ubisoft", "samsung", "texas instruments", "walmart", "walmart global tech", "target", "visa", "mastercard",
    "paypal", "american express", "jpmorgan chase", "goldman sachs", "morgan stanley", "deutsche bank", "barclays", "wells fargo",
    "citi", "intuit", "autodesk", "siemens", "philips", "thomson reuters", "expedia", "booking.com", "twilio", "stripe", "databricks",
    "snowflake", "mongodb", "confluent", "cloudflare", "datadog", "rubrik", "nutanix", "palo alto networks", "zscaler", "crowdstrike",
    "okta", "hubspot", "zoom", "dropbox", "grammarly", "canva", "figma", "notion", "razorpay", "flipkart", "phonepe", "paytm", "cred",
    "zepto", "swiggy", "zomato", "meesho", "groww", "zerodha", "postman", "browserstack", "freshworks", "zoho", "chargebee", "inmobi",
    "ola", "dream11", "sprinklr", "sharechat", "unacademy", "urban company", "nykaa", "lenskart", "myntra", "rapido", "slice", "jupiter",
)

# Sources, by how directly they come from the employer.
EMPLOYER_SOURCES = (
    "greenhouse", "lever", "ashby", "smartrecruiters", "workday", "google", "amazon", "amazon_campus", "avature", "juspay", "oracle",
    "microsoft", "apple", "atlassian", "goldman", "ibm", "eightfold", "workable_boards", "freshteam", "recruitee", "gem", "rippling",
    "successfactors", "keka", "zoho_recruit",
)
SEARCH_SOURCES = ("workable", "vc_getro", "vc_consider", "instahyre", "yc_jobs")
AGGREGATORS = ("himalayas", "jobicy", "weworkremotely", "hn_hiring", "remoteok", "remotive", "arbeitnow")
ATS_SOURCES = (*EMPLOYER_SOURCES, *SEARCH_SOURCES, "simplify")
#: 0 the employer's own system, 1 searches that link to it, 2 a curated feed, 3 aggregators; 5 for others.
SOURCE_PRIORITY = (
    {s: 0 for s in EMPLOYER_SOURCES} | {"amazon_campus": 1} | {s: 1 for s in SEARCH_SOURCES} | {"simplify": 2} | {s: 3 for s in AGGREGATORS}
)
DEFAULT_PRIORITY = 5

# URLs.
TRACKING = r"(?i)^(utm_\w+|ref|referrer|source|src|gh_src|lever-source|fbclid|gclid|mc_cid|mc_eid|_hsenc|_hsmi|trk|trackingId)$"
DEDUPE_TRACKING = r"(?i)^(utm_\w+|ref|referrer|source|src|gh_src|lever-source|lever-origin|fbclid|gclid|mc_cid|mc_eid|_hsenc|_hsmi|trk|trackingId|mode|session)$"
AGGREGATOR_HOSTS = (
    "arbeitnow.com", "arbeitnow.fr", "arbeitnow.de", "remoteok.com", "remoteok.io", "remotive.com", "remotive.io", "himalayas.app",
    "weworkremotely.com", "jobs.workable.com", "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "simplyhired.com",
    "jooble.org", "news.ycombinator.com",
)
ATS_SIGNATURES = (
    ("greenhouse", r"(?i)(boards\.greenhouse\.io|job-boards\.greenhouse\.io|gh_jid=|greenhouse\.io/embed)"),
    ("lever", r"(?i)(jobs\.lever\.co|lever\.co/[\w-]+/)"),
    ("ashby", r"(?i)(jobs\.ashbyhq\.com|ashbyhq\.com/[\w-]+)"),
    ("workday", r"(?i)(myworkdayjobs\.com|\.wd\d+\.myworkday)"),
    ("smartrecruiters", r"(?i)(jobs\.smartrecruiters\.com|smartrecruiters\.com/[\w-]+)"),
    ("workable", r"(?i)(apply\.workable\.com|\.workable\.com/j/)"),
    ("recruitee", r"(?i)\.recruitee\.com"),
    ("eightfold", r"(?i)(\.eightfold\.ai|jobs\.eightfold)"),
    ("successfactors", r"(?i)(successfactors\.(com|eu)|sapsf\.(com|eu))"),
    ("icims", r"(?i)\.icims\.com"),
    ("taleo", r"(?i)\.taleo\.net"),
    ("jobvite", r"(?i)\.jobvite\.com"),
    ("darwinbox", r"(?i)\.darwinbox\.(in|com)"),
    ("teamtailor", r"(?i)\.teamtailor\.com"),
)

# Caps and weights.
MAX_AGE_DAYS, ATS_MAX_AGE_DAYS, INTERN_MAX_AGE_DAYS, PLAUSIBLE_AGE_DAYS = 14, 150, 60, 400
MAX_MIN_YOE = 0
GRADUATION_YEAR = 2027
SMALL_TEAM = 50
WEIGHTS = {"reachability": 28, "stage": 25, "stack": 18, "company": 15, "freshness": 9, "role": 3, "confidence": 2}
