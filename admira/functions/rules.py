"""Word lists, patterns and constants of the rules. All are defaults of parameters."""

# Phrases and words that mark boilerplate.
PAGE_NOISE = [
    "home about", "menu", "search close menu", "faculty students alumni staff", "copyright", "privacy policy", "terms of use",
    "apply online", "program planning guide", "financial assistance", "admissions undergraduate programs", "postgraduate programs",
    "centers of excellence", "student portal", "faculty portal", "office of the registrar", "academic calendar", "social networks",
    "view other fee structures", "download",
]
NAVIGATION_WORDS = ["admissions", "programs", "undergraduate", "graduate", "mba", "fee structure"]
RECORD_NOISE = [
    "home about", "admissions undergraduate programs", "graduate programs", "postgraduate programs", "centers of excellence",
    "apply online", "program planning guide", "fee structure", "financial assistance", "aptitude tests", "samples faqs",
    "academics schools", "academic calendar", "office of the registrar", "life at iba", "student portal", "faculty portal",
    "portals", "menu", "social networks", "copyright", "©", "privacy policy", "terms of use", "contact us",
    "faculty students alumni staff", "search close menu",
]
HOUSING_NOISE = ["academic accommodation", "religious accommodation", "disability", "examination schedule", "fyp showcase", "final year project"]

# Patterns of percentages, tests, housing statements and degrees.
PERCENT_PATTERNS = [r"(?i)(\d{1,3}(?:\.\d+)?)\s*%\s*minimum\s*marks", r"(?i)minimum\s*(\d{1,3}(?:\.\d+)?)\s*%", r"(?i)at\s*least\s*(\d{1,3}(?:\.\d+)?)\s*%"]
ENTRY_TESTS = ["NAT", "ECAT", "MDCAT", "ETEA", "GAT", "HAT", "NTS", "SAT", "MCAT", "FAST-NUCES", "NU Admission Test", "ISSB"]
HOUSING_POSITIVE = r"(?i)operates?\s+(a|an|its own)?\s*(dedicated\s+)?[\w\s]{0,30}hostel|official[\w\s]{0,20}hostel|dedicated[\w\s]{0,20}hostel|provides?[\w\s]{0,20}hostel"
HOUSING_NEGATIVE = r"(?i)does\s*not\s*(operate|have|provide|offer)|no\s*(on-?campus|onsite)\s*(hostel|housing|accommodation)|not\s*available|non-?residential\s*campus"
DEGREE_LEVELS = [("PhD", r"(?i)\bph\.?\s?d\b"), ("Master", r"(?i)\b(ms|m\.s\.|mba|master(?:'s)?|master of)\b"), ("Bachelor", r"(?i)\b(bs|b\.s\.|bba|bachelor(?:'s)?|bachelor of)\b")]

# Page types by words in address or title, and the word lists of extracted fields with their limits.
PAGE_TYPES = {
    "eligibility": ["eligibil", "eligible"],
    "test_pattern": ["test pattern", "entry test", "past entry", "admissions/testpattern", "aptitude"],
    "fee": ["fee", "tuition", "hostel", "transport", "finance"],
    "scholarship": ["scholar", "financial assistance", "bursary", "grant"],
    "courses": ["course", "program", "curriculum", "offeredprogram", "courseoutline"],
}
FIELD_WORDS = {
    "eligibility_criteria": (["eligibility", "minimum marks", "must have", "required to apply", "eligible", "merit list", "admission test"], 8),
    "test_pattern": (["test pattern", "aptitude test", "admission test", "entry test", "sat", "interview", "weightage", "negative marking", "section"], 8),
    "scholarships": (["scholarship", "financial aid", "fee concession", "funding", "support", "grant", "bursary", "assistance"], 6),
    "hostel_info": (["hostel", "dormitory", "student housing", "accommodation", "residence", "boarding"], 6),
}

# Programme and fee tables.
PROGRAM_INDICATOR = r"(?i)\b(?:bs|b\.s\.|bsc|ms|m\.s\.|phd|ph\.d|bachelor|master|doctor|pharm\.?d|dpt|engineering|computer science|software engineering|data science|cyber security|business administration|accounting and finance|economics|mathematics|information technology)\b"
CATALOG_CODE = r"\b(CSE|MTS|SSC|SCI|HUM|ENG|PHY|MATH|BIO|ECE|EEE)\d{2,3}\b"
CATALOG_WORDS = r"(?i)\b(Course Code|Credit hours|Semester|Program Core|General Education|CS Core|Elective|Required Courses|Course Title|Duration|Total|Section/Topic|Grade|Course Category|Hours|Prerequisite|Pre-requisite|Category)\b"
COST_WORDS = r"(?i)\b(rs|pkr|rupees|fee|fee per credit hour|student activity charges|hostel|transport|amount|admission charges|security deposit|transfer fee|refund|credit hour|per semester)\b"
NON_PROGRAM_MARKERS = ["weightage", "selection criteria", "courses studied at", "admission test", "merit list", "negative marking", "past academic record", "cut-off", "eligibility", "ibcc", "hssc", "selection weightage"]
GENERIC_LABELS = ["engineering", "business administration", "computing", "computer science", "science"]
PROGRAM_START = r"(?i)^(bachelor\b(?:'s)?(?:\s+of)?|master\b(?:'s)?(?:\s+of)?|doctor\s+of|associate\s+of|bs[\s\-(]|bs$|b\.s\.|bba\b|ms[\s\-(]|ms$|m\.s\.|mba\b|phd\b|ph\.d\.?|be\b|b\.e\.|m\.?engg\.?\b|mem\b)"
GARBLE = r"(?i)\b(faculty|designation)\b"
DURATION_AHEAD = r"(?i)(?=\d+(?:\.\d+)?\s*years?\b)"
DURATION_PREFIX = r"(?i)^\d+(?:\.\d+)?\s*years?\s*"
FEE_LABEL_STOPWORDS = ["program", "amount in pkr", "fee", "fee per credit hour", "student activity charges", "timeline", "one-time charges"]
FEE_VALUE_STOPWORDS = ["fee", "amount in pkr", "program"]
AMOUNT_LIKE = r"(?i)^(rs\.?|pkr|us\s*\$|\$|£)?\s*[\d,]+(\.\d+)?%?/?-?$"
FEE_CURRENCY = r"(?i)\bpkr\b|\brupees\b|\bsemester\b|\bcredit\b|\brs\.?\s*[\d,]"

# Field-of-study labels.
FIELD_DEGREE = r"(?i)^(?:bachelor(?:\s+of\s+(?:science|arts|business administration|education|engineering|laws?|architecture|interior design))?|master(?:\s+of\s+(?:science|arts|business administration|philosophy|engineering))?|doctor of philosophy|phd|b\.?\s*s\.?|b\.?\s*e\.?|b\.?\s*a\.?|b\.?\s*ba|bs|be|bba|ba|m\.?\s*s\.?|m\.?\s*ba|m\.?\s*engg\.?|ms|mba|mem|m\.?sc|b\.?sc|b\.?\s*ed\.?|pharm\.?\s*d\.?|dpt)\b[\s.\-]*"
FIELD_JUNK = r"(?i)(admission|required|instruction|overview|curriculum|faculty|dissertation|equivalent|cgpa|hec|years of|valid for|compulsory|ranked by|accredited|cr\.?\s*hrs|4-year program|weekend|evening|thesis is|plo\b)"
FIELD_REJECTED = ["the", "and", "of", "cls & ri", "per 3 cr.hrs"]
FIELD_SMALL_WORDS = ["and", "of", "with", "in", "for", "the", "a", "an"]
FIELD_ACRONYMS = ["ai", "cs", "it", "se", "mba", "bba", "ms", "bs"]
FIELD_ALIASES = {
    "computer sciences": "Computer Science",
    "in computer science": "Computer Science",
    "in computer engineering": "Computer Engineering",
    "in electrical engineering": "Electrical Engineering",
    "in business administration": "Business Administration",
    "accounting and finance": "Accounting & Finance",
    "computer network & security": "Computer Networks & Security",
    "computer networks and security": "Computer Networks & Security",
    "business analytics and programming": "Business Analytics & Programming",
    "international relation": "International Relations",
    "master of business administration": "Business Administration",
    "bba / bba honors": "Business Administration",
    "business administration": "Business Administration",
    "pharm.d.": "Pharmacy (Pharm.D.)",
    "pharm.d": "Pharmacy (Pharm.D.)",
    "dpt": "Doctor of Physical Therapy",
    "b.ed": "Education (B.Ed)",
    "textile sciences.": "Textile Sciences",
    "media sciences) the": "Media Sciences",
}

# Prefixes that titles drop.
TITLE_PROFILE_PREFIX = "always use my saved profile"
TITLE_PROFILE_MARKER = r"(?i)^.*?unless something is missing\.?\s*"
TITLE_PROFILE_SENTENCE = r"(?i)^Always use my saved profile\b[^.]*(?:\.[^.]*)?\.\s*"
TITLE_PREFIXES = [
    r"(?i)^Answer about .+? only\.\s*(?:Do not recommend other universities\.\s*)?",
    r"(?i)^Limit the answer to .+? only\s*[—\-–]?\s*(?:do not recommend other universities\.\s*)?",
]

# Profile fields with their weights, and those that a conversation needs.
PROFILE_WEIGHTS = {
    "name": 5, "email": 5, "phone": 5, "current_education_level": 10, "academic_percentage": 15, "field_of_study": 15,
    "budget_pkr_per_semester": 10, "scholarship_required": 5, "hostel_required": 5, "degree_level": 10, "preferred_province": 10,
    "student_city": 5, "student_area": 5, "priority_focus": 5,
}
REQUIRED_FIELDS = ["field_of_study", "degree_level", "budget_pkr_per_semester", "preferred_province", "academic_percentage", "current_education_level"]

# Stages of education.
STAGE_PATTERNS = [
    (0, r"(?i)\bgrade\s*(?:[1-9]|10)\b|\bclass\s*(?:[1-9]|10)\b|\bprimary\b|\bmiddle\s*school\b|\belementary\b|\bjunior\s*school\b"),
    (1, r"(?i)\bmatric(?:ulation)?\b|\bo[\s\-]?levels?\b"),
    (2, r"(?i)\bintermediate\b|\bf\.?sc\b|\ba[\s\-]?levels?\b|\bhssc\b"),
]
DEGREE_STAGES = [(3, r"(?i)\bbachelor|\bbs\b|\bbba\b"), (4, r"(?i)\bmaster|\bms\b|\bmba\b"), (5, r"(?i)\bph\.?d\b")]
COMPLETION = r"(?i)\b(completed?|done|finished|graduat\w*|holds?|has|earned|obtained)\b"
STAGE_NEEDED = {"Bachelor": 2, "Master": 3, "PhD": 4}

# Intents of messages.
FOCUS_WORDS = r"(?i)\b(compare|comparison|vs\.?|versus|between|shortlist|short[\s-]?listed|shortlisted|these universities|among these|for me:|only look at|narrow to|focus on)\b"
CATEGORY_WORDS = {
    "scholarships": ["scholarship", "financial aid", "fee concession", "bursary", "grant", "need-based", "need based"],
    "hostel": ["hostel", "dormitory", "accommodation", "residence", "boarding"],
    "fee_structure": ["fee", "tuition", "cost", "afford", "expensive", "cheap"],
    "eligibility": ["eligib", "requirement", "admission criteria", "how easy", "how hard", "merit", "cut off", "cutoff"],
    "test_pattern": ["entry test", "aptitude test", "admission test", "test pattern"],
    "offered_courses": ["program", "course", "degree offered", "majors", "specialization"],
}
EXPLANATION_PATTERNS = [
    r"\bwhy\b.*\b(rank|ranked|recommend|match|score|#1|first|top|fit)\b",
    r"\bwhy\b.*\b(higher|better|ideal|best)\b",
    r"\bexplain\b.*\b(rank|ranking|recommend|match|score|fit)\b",
    r"\bbreak\s*down\b.*\b(match|rank|factor|fit)\b",
    r"\bmatch factors?\b",
    r"\bhow\b.*\b(rank|ranked|score|match)\b",
    r"\bwhat makes\b.*\b(good|best|top|ideal|fit)\b",
]
RERANK_WORDS = r"(?i)\b(re-?rank|new (ranked )?list|updated? (list|ranking|recommendations)|show (me )?(new )?(options|fits|recommendations|universities)|recommend (the )?(best |top )?((university |school )?fits|universities|schools|options)|change (my )?(budget|priority|field|province|city|criteria))\b"
FOLLOWUP_WORDS = r"(?i)\b(why|how (do|to|can|should|does|is|are)|explain|break\s*down|tell me|what (are|is|does|do|about)|fees?|tuition|budget|costs?|afford|scholarships?|eligib\w*|hostel|admissions?|deadlines?|documents?|entry tests?|aptitude tests?|apply|application|next steps|application plan|how to apply|fit for|match factors?|limit the answer|answer about)\b"
QUESTION_WORDS = r"(?i)\b(what|which|how|when|where|why|tell me|explain|compare|show me)\b"
QUESTION_INDICATOR = r"(?i)\?|\bscholarship|\bhostel|\bfee|\btuition|\beligib|\badmission|\bentry test|\bdeadline|\bmerit|\brequirement|\bhow (easy|hard|do|much)|\bwhat (is|are)|\bdo(es)? (you|they|it)\b"
CHART_PHRASES = ["analytics chart", "chart data snapshot", "agent takeaways", "university dataset field completeness"]
FIRST_WORDS = r"\b(first|#1|top|ranked highest|leading)\b"

# Factors of the ranking, in order, their weights, and the factor that a priority raises by so many points.
FACTOR_LABELS = {
    "program_match": "Program available",
    "eligibility_match": "Meets eligibility",
    "budget_fit": "Fits budget",
    "scholarship_fit": "Scholarship available",
    "location_fit": "Preferred location",
    "goal_alignment": "Career goal alignment",
}
FACTOR_WEIGHTS = {"program_match": 25, "eligibility_match": 20, "budget_fit": 20, "location_fit": 15, "scholarship_fit": 10, "goal_alignment": 10}
PRIORITY_FACTORS = {"fees": "budget_fit", "distance": "location_fit"}
PRIORITY_POINTS = 10

# Themes of programmes in the dashboard.
PROGRAM_THEMES = [
    ("Computer Science", ["computer science", "bs cs", "bscs", "software"]),
    ("Engineering", ["engineering", "electrical", "mechanical", "civil"]),
    ("Business / BBA", ["bba", "business", "management", "commerce"]),
    ("Data / AI", ["data science", "artificial intelligence", "ai ", "machine learning"]),
    ("Media / Design", ["media", "design", "communication"]),
    ("Medicine / Health", ["medical", "health", "pharmacy", "nursing"]),
    ("Law", ["law", "llb"]),
    ("Social Sciences", ["social", "psychology", "economics", "english"]),
]

# Stages offered in forms, with the patterns that show them in a corpus, and the default.
EDUCATION_OPTIONS = [
    ("Matric / O-Levels in progress", [r"\bmatric(?:ulation)?\b", r"\bo[\s\-]?levels?\b"]),
    ("Matric / O-Levels completed", [r"\bmatric(?:ulation)?\b", r"\bo[\s\-]?levels?\b"]),
    ("Intermediate / FSc (Pre-Engineering) in progress", [r"\bpre[\s\-]?engineering\b", r"\bintermediate\b", r"\bf\.?\s*sc\b", r"\bhssc\b"]),
    ("Intermediate / FSc (Pre-Engineering) completed", [r"\bpre[\s\-]?engineering\b", r"\bintermediate\b", r"\bf\.?\s*sc\b", r"\bhssc\b"]),
    ("Intermediate / FSc (Pre-Medical) in progress", [r"\bpre[\s\-]?medical\b", r"\bintermediate\b"]),
    ("Intermediate / FSc (Pre-Medical) completed", [r"\bpre[\s\-]?medical\b", r"\bintermediate\b"]),
    ("Intermediate / ICS (Computer Science) completed", [r"\bics\b", r"\bcomputer science\b.*\bintermediate\b", r"\bintermediate\b.*\bcomputer science\b"]),
    ("Intermediate / Commerce completed", [r"\bcommerce\b", r"\bintermediate\b"]),
    ("A-Levels in progress", [r"\ba[\s\-]?levels?\b"]),
    ("A-Levels completed", [r"\ba[\s\-]?levels?\b"]),
    ("DAE (Diploma of Associate Engineering) completed", [r"\bdae\b", r"\bdiploma of associate\b"]),
    ("Bachelor's degree in progress", [r"\bbachelor", r"\bbs\b", r"\bbba\b", r"\bundergraduate\b"]),
    ("Bachelor's degree completed", [r"\bbachelor", r"\bbs\b", r"\bbba\b", r"\b16 years\b"]),
    ("Master's / MS / MPhil completed", [r"\bmaster", r"\bmphil\b", r"\bms\b", r"\b18 years\b"]),
]
EDUCATION_DEFAULT = ["Matric / O-Levels completed", "Intermediate / FSc (Pre-Engineering) completed", "A-Levels completed", "Bachelor's degree completed"]
