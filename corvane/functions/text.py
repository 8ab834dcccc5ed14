"""Text to typed columns (X1-X30), built-in functions wherever they can say it."""

from __future__ import annotations

import html as html_entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import rules
from corvane.functions.places import lookup

#: Words of a title that name the sought roles, and those that rule it out.
ROLE_TOKENS = ["intern", "interns", "internship", "internships", "co-op", "coop", "coops", "apprentice", "apprentices", "apprenticeship", "apprenticeships"]
EXCLUDED_TITLES = [
    "senior", "sr.", "sr ", "staff", "principal", "manager", "director", "lead", "vp", "head of", "distinguished", "fellow", "phd",
    "supply chain", "manufacturing", "mechanical", "hardware", "marketing", "finance", "sales", "legal", "recruiting", "design systems", "data science",
    "ios", "android", "mobile",
]

#: The categories' keywords, in the order in which categories are listed.
CATEGORY_KEYWORDS = {
    "software_engineering": [
        "software engineer", "swe", "sde", "backend", "back end", "back-end", "frontend", "front end", "front-end", "fullstack", "full stack", "full-stack", "web developer",
        "ios developer", "android developer", "mobile developer", "platform engineer", "devops", "site reliability", "sre", "embedded", "firmware", "systems engineer",
    ],
    "machine_learning_and_ai": [
        "machine learning", "ml engineer", "ai engineer", "deep learning", "nlp", "llm", "computer vision", "data scientist", "research scientist", "applied scientist",
        "artificial intelligence", "generative ai",
    ],
    "data_analysis": ["data analyst", "business intelligence", "bi analyst", "analytics engineer", "data analytics", "reporting analyst"],
    "data_engineering": ["data engineer", "data pipeline", "etl", "data infrastructure", "data platform"],
    "cybersecurity": ["security engineer", "cybersecurity", "cyber security", "infosec", "penetration test", "devsecops", "security analyst", "soc analyst", "threat intelligence"],
    "product_management": ["product manager", "product management", "pm intern", "associate pm", "apm", "technical product"],
    "business_analyst": ["business analyst", "business analysis", "systems analyst", "process analyst", "operations analyst"],
    "consulting": ["consultant", "consulting", "advisory services", "strategy analyst", "management consulting", "strategy consultant"],
    "accounting_and_finance": [
        "accountant", "accounting", "financial analyst", "investment banking", "equity research", "financial audit", "tax analyst", "treasury analyst", "corporate controller",
    ],
    "marketing": [
        "marketing", "demand generation", "brand marketing", "brand manager", "content marketing", "seo specialist", "digital marketing", "social media marketing",
        "social media manager", "marketing campaign", "communications specialist", "communications manager",
    ],
    "sales": [
        "sales representative", "sales associate", "sales executive", "sales development", "account executive", "business development", "bdr", "sdr", "revenue operations", "account manager",
    ],
    "creatives_and_design": [
        "designer", "ux design", "ui design", "ux/ui", "product design", "graphic design", "visual design", "motion design", "brand design", "illustrator",
    ],
    "engineering_and_development": [
        "hardware engineer", "electrical engineer", "mechanical engineer", "chemical engineer", "aerospace engineer", "civil engineer", "industrial engineer", "manufacturing engineer",
    ],
    "human_resources": [
        "human resources", "hr generalist", "hr manager", "hr business partner", "recruiter", "recruiting coordinator", "talent acquisition", "people operations", "hris",
    ],
    "legal_and_compliance": [
        "legal counsel", "legal associate", "legal analyst", "compliance officer", "compliance analyst", "compliance manager", "paralegal", "regulatory affairs",
        "regulatory compliance", "general counsel", "attorney", "contracts manager", "contracts specialist",
    ],
    "management_and_executive": ["operations manager", "chief of staff", "corporate strategy", "strategy manager", "corporate development", "general manager"],
    "public_sector_and_government": ["government relations", "public sector", "public policy", "federal government", "defense contractor", "intelligence analyst", "civic engagement"],
    "customer_service_and_support": ["customer success", "customer support", "customer service", "client success", "technical support", "help desk"],
    "education_and_training": [
        "teaching", "curriculum design", "instructional design", "e-learning", "learning experience", "learning designer", "tutor", "training program", "training specialist", "training coordinator",
    ],
    "health care": [
        "health care", "healthcare", "clinical research", "clinical trial", "medical device", "medical affairs", "biotech", "pharmaceutical", "nursing", "patient care", "patient experience",
    ],
    "supply_chain": [
        "supply chain", "logistics", "procurement", "sourcing specialist", "inventory management", "warehouse operations", "fulfillment", "logistics operations", "fleet operations",
    ],
    "arts_and_entertainment": [
        "entertainment industry", "media production", "film production", "music industry", "gaming industry", "game developer", "animation", "video production", "content production", "broadcast",
    ],
    "project_management": ["project manager", "program manager", "pmo", "scrum master", "agile coach", "project coordinator"],
}

#: Departments and functions that stand for one category.
FUNCTION_CATEGORIES = {
    "Information Technology": "software_engineering", "Consulting": "consulting", "Health Care Provider": "health care", "Sales": "sales", "Business Development": "sales",
    "Marketing": "marketing", "Advertising": "marketing", "Public Relations": "marketing", "Writing/Editing": "marketing", "Human Resources": "human_resources",
    "Legal": "legal_and_compliance", "Finance": "accounting_and_finance", "Accounting/Auditing": "accounting_and_finance", "Supply Chain": "supply_chain", "Distribution": "supply_chain",
    "Purchasing": "supply_chain", "Project Management": "project_management", "Product Management": "product_management", "Education": "education_and_training",
    "Training": "education_and_training", "Strategy/Planning": "management_and_executive", "Manufacturing": "engineering_and_development", "Production": "engineering_and_development",
    "Quality Assurance": "engineering_and_development", "Engineering": "engineering_and_development", "Design": "creatives_and_design", "Art/Creative": "creatives_and_design",
}
DEPARTMENT_CATEGORIES = {
    "engineering": "software_engineering", "vehicle engineering": "engineering_and_development", "product": "product_management", "sales": "sales", "business development": "sales",
    "marketing": "marketing", "people & talent": "human_resources", "hr & employee experience": "human_resources", "legal & licensing": "legal_and_compliance", "legal": "legal_and_compliance",
    "compliance": "legal_and_compliance", "regulatory & compliance": "legal_and_compliance", "finance": "accounting_and_finance", "finance & corporate development": "accounting_and_finance",
    "design": "creatives_and_design", "creative": "creatives_and_design", "customer experience": "customer_service_and_support", "security": "cybersecurity",
}
GREENHOUSE_CATEGORIES = {
    "engineering": "software_engineering", "software engineering": "software_engineering", "software": "software_engineering", "software development": "software_engineering",
    "hardware": "engineering_and_development", "hardware engineering": "engineering_and_development", "mechanical engineering": "engineering_and_development",
    "manufacturing": "engineering_and_development", "sales": "sales", "field sales": "sales", "enterprise sales": "sales", "business development": "sales", "sales development": "sales",
    "account management": "sales", "finance": "accounting_and_finance", "accounting": "accounting_and_finance", "marketing": "marketing", "paid media": "marketing",
    "product management": "product_management", "product": "product_management", "legal": "legal_and_compliance", "compliance": "legal_and_compliance", "human resources": "human_resources",
    "information technology": "software_engineering", "customer success": "customer_service_and_support", "customer support": "customer_service_and_support",
    "customer service": "customer_service_and_support", "supply chain": "supply_chain", "design": "creatives_and_design",
}

#: Metadata names under which sources keep the same fact.
METADATA_NAMES = {
    "employment_type": ["Employment Type", "Employment type", "Employment Status", "Full-time/ Part-time", "Full Time/Part Time", "Full/Part Time", "Worker Type"],
    "workplace_type": ["Remote", "Remote?", "Workplace Type", "Work Arrangement", "Work Mode", "Work Model"],
    "experience_level": ["Experience Level", "Experience level", "Experience Type", "Job Level", "Career Level", "Seniority Level"],
    "salary_range": ["Salary", "Salary Range", "Salary Range_Pay Transparency", "Job Posting Salary Range", "Pay Range"],
    "category_metadata": ["Job Category", "Category", "Job Family", "Job Family Group", "Function", "Job Function", "Career Page Posting Category"],
}

#: URL shapes of applicant systems, first match first, and signs of them in pages.
ATS_URLS = [
    ("greenhouse", r"boards\.greenhouse\.io/([^/?#]+)"), ("lever", r"jobs\.lever\.co/([^/?#]+)"), ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([^/?#]+)"), ("workday", r"([^.]+)\.myworkdayjobs\.com"), ("icims", r"([^.]+)\.icims\.com"),
    ("jobvite", r"jobs\.jobvite\.com/([^/?#]+)"), ("greenhouse", r"boards-api\.greenhouse\.io/v1/boards/([^/?#]+)"),
]
ATS_SIGNS = {
    "greenhouse": ["boards.greenhouse.io", "grnh.se"], "lever": ["jobs.lever.co", "lever.co/apply"], "ashby": ["jobs.ashbyhq.com", "ashbyhq.com"],
    "smartrecruiters": ["jobs.smartrecruiters.com"], "workday": ["myworkdayjobs.com", "workday.com/en-US/pages"], "icims": [".icims.com/jobs/"], "jobvite": ["jobs.jobvite.com"],
    "bamboohr": ["bamboohr.com/jobs/", "app.bamboohr.com"],
}
POLLED = ["ashby", "greenhouse", "lever", "smartrecruiters"]

#: Legal suffixes of company names.
COMPANY_SUFFIXES = (
    "inc\\.?", "incorporated", "llc", "ltd\\.?", "limited", "corp\\.?", "corporation", "co\\.?", "plc", "gmbh", "ag", "sa", "technologies", "technology", "tech", "solutions", "group",
    "holdings", "services", "international", "systems", "global",
)

#: Words that say nothing about a posting.
STOP_WORDS = [
    "the", "and", "for", "but", "not", "all", "any", "can", "had", "her", "was", "one", "our", "out", "get", "has", "him", "his", "how", "its", "may",
    "new", "now", "old", "see", "two", "way", "who", "did", "let", "put", "say", "she", "too", "use", "with", "that", "this", "from", "have", "will",
    "been", "they", "were", "what", "when", "your", "more", "also", "some", "than", "then", "into", "over", "such", "make", "like", "time", "just",
    "know", "take", "good", "much", "need", "even", "most", "well", "only", "very", "able", "back", "each", "must", "high", "long", "down", "both",
    "help", "give", "used", "here", "every", "those", "these", "other", "would", "their", "there", "which", "about", "after", "where", "while",
    "could", "should", "through", "during", "before", "within", "between", "using", "based", "across", "without", "including", "role", "team", "join",
    "position", "looking", "seeking", "candidate", "responsibilities", "requirements", "qualifications", "required", "preferred", "strong",
    "excellent", "great", "ideal", "background", "ability", "skills", "knowledge", "understanding", "familiarity", "proficiency", "comfortable",
    "proven", "demonstrated", "exposure", "plus", "bonus", "nice", "minimum", "least", "years", "year", "months", "month", "hands", "work", "working",
    "experience", "related", "relevant", "equivalent", "similar", "following", "etc", "e.g", "i.e",
]

#: Resume sections, and technologies with their typical endings.
SECTIONS = ["experience", "education", "skills", "projects", "summary", "objective", "certifications", "awards"]
TECHNOLOGIES = [
    "docker", "kubernetes", "postgres", "postgresql", "redis", "nginx", "terraform", "ansible", "linux", "ubuntu", "debian", "jenkins", "grafana",
    "prometheus", "hadoop", "spark", "kafka", "airflow", "tableau", "figma", "sketch", "jira", "confluence", "github", "gitlab", "bitbucket",
    "heroku", "vercel", "netlify", "firebase", "mongodb", "elasticsearch", "rabbitmq", "celery", "flask", "django", "fastapi", "pytorch",
    "tensorflow", "numpy", "pandas", "scipy", "matplotlib", "scrapy", "selenium", "playwright",
]
TECH_ENDINGS = ["js", "py", "sql", "api", "sdk", "cli", "css", "ml", "ai", "db"]

#: How years of experience are written.
_YEARS = r"\s*\+?\s*years?\s+(?:of\s+)?(?:relevant\s+|professional\s+|industry\s+|work(?:ing)?\s+)?experience"
EXPERIENCE = r"(?iU)(?:(\d{1,2})\s*(?:-|to|–|—)\s*(\d{1,2})" + _YEARS + r"|(\d{1,2})" + _YEARS + ")"


def is_role(title: Column) -> Column:
    """A title that holds a role's token and nothing that rules it out."""
    tokens = F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9\-]+"), F.lit(0))
    return ~title.rlike(rules.any_word(EXCLUDED_TITLES)) & F.arrays_overlap(tokens, F.array(*map(F.lit, ROLE_TOKENS)))


def experience_years(*texts: Column) -> Column:
    """(min, max) of the first text that states them; null where none does. A single number has no max."""
    found = []
    for text in texts:
        group = lambda k, text=text: F.nullif(F.regexp_extract(text, EXPERIENCE, k), F.lit("")).cast("int")
        found.append(F.when(text.rlike(EXPERIENCE), F.struct(F.coalesce(group(1), group(3)).alias("min"), group(2).alias("max"))))
    return F.coalesce(*found)


def categories(title: Column, description: Column, table: dict[str, list[str]] | None = None) -> Column:
    """All categories of the title; only where there are none, those of title and description."""
    patterns = {name: rules.any_word(words) for name, words in (table or CATEGORY_KEYWORDS).items()}
    own = rules.all_matching(title, patterns)
    return F.when(F.size(own) > 0, own).otherwise(rules.all_matching(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))), patterns))


def category_of_function(label: Column) -> Column:
    return lookup(FUNCTION_CATEGORIES, label)


def category_of_department(name: Column, table: dict[str, str] | None = None) -> Column:
    """X4 for a single name, letter case apart."""
    return lookup(table or DEPARTMENT_CATEGORIES, F.lower(F.trim(name)))


def category_of_departments(names: Column) -> Column:
    """That of the first name that has one."""
    mapped = F.filter(F.transform(names, lambda n: category_of_department(n, GREENHOUSE_CATEGORIES)), lambda c: c.isNotNull())
    return F.try_element_at(mapped, F.lit(1))


def first_value(metadata: Column, names: list[str]) -> Column:
    """The first value, under any of the names, that says something."""
    stated = F.filter(metadata, lambda e: e["name"].isin(*names) & e["value"].isNotNull() & ~e["value"].isin("null", ""))
    return F.get(F.transform(stated, lambda e: e["value"]), F.lit(0))


def salary_range(value: Column) -> Column:
    """(unit, min_value, max_value) of a JSON range; one without numbers, or of two zeros, is none."""
    part = lambda p: F.get_json_object(value, f"$.{p}")
    blank = lambda p: part(p).isNull() | (part(p) == "0.0")
    return F.when(~(blank("min_value") & blank("max_value")), F.struct(*(part(p).alias(p) for p in ("unit", "min_value", "max_value"))))


def slug_of_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: An aggregator's names of categories for graduates, where they differ.
GRADUATE_CATEGORIES = {
    "swe": "software_engineering", "ml_ai": "machine_learning_and_ai", "data_analysis": "data_analysis", "cyber_security": "cybersecurity", "project_manager": "project_management",
}


def aggregator_category(slug: Column, job_type: Column) -> Column:
    """An aggregator's category under the common name."""
    return F.when(job_type == "newgrad", F.coalesce(lookup(GRADUATE_CATEGORIES, slug), slug)).otherwise(slug)


def slug_candidates(name: Column) -> Column:
    """X11: with hyphens and without, first without the legal suffix and then with it."""
    base = F.trim(F.lower(name))
    bare = F.trim(F.regexp_replace(base, r"[\s,]+(?:" + "|".join(COMPANY_SUFFIXES) + r")\s*$", ""))
    squashed = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    return F.filter(F.array_distinct(F.array(slug_of_name(bare), squashed(bare), slug_of_name(base), squashed(base))), lambda s: s != "")


def bare_domain(url: Column) -> Column:
    """Host with port, without www., lower-cased; a missing scheme is added."""
    url = F.trim(url)
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    netloc = F.regexp_extract(full, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(url != "", F.nullif(F.lower(F.regexp_replace(netloc, r"^www\.", "")), F.lit("")))


def ats_of_url(url: Column) -> Column:
    """(ats, slug) by the first URL shape that fits."""
    found = []
    for ats, pattern in ATS_URLS:
        slug = F.rtrim(F.trim(F.lower(F.regexp_extract(url, pattern, 1))), F.lit("/"))
        found.append(F.when(slug != "", F.struct(F.lit(ats).alias("ats"), slug.alias("slug"))))
    return F.coalesce(*found)


def ats_of_page(html: Column) -> Column:
    """(ats, slug) by signs in a page, with the slug of the first link that belongs to that system."""
    ats = F
    for name, signs in ATS_SIGNS.items():
        hit = F.contains(html, F.lit(signs[0]))
        for sign in signs[1:]:
            hit = hit | F.contains(html, F.lit(sign))
        ats = ats.when(hit, name)
    ats = ats.otherwise(F.lit(None).cast("string"))
    links = F.regexp_extract_all(html, F.lit("(?i)(?:href|src)=[\"']([^\"'>\\s]+)[\"']"), F.lit(1))
    own = F.filter(F.transform(links, ats_of_url), lambda d: d["ats"] == ats)
    return F.when(ats.isNotNull(), F.struct(ats.alias("ats"), F.get(own, F.lit(0))["slug"].alias("slug")))


def keywords(text: Column) -> Column:
    """Words and hyphenated terms of more than two letters that aren't stop words, once each, in order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*(?:-[a-z][a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def keyword_split(wanted: Column, text: Column) -> Column:
    """The keywords present in a text, hyphens read as spaces too, and the missing ones."""
    low = F.lower(text)
    there = lambda k: F.contains(low, k) | (F.contains(k, F.lit("-")) & F.contains(low, F.replace(k, F.lit("-"), F.lit(" "))))
    return F.struct(F.filter(wanted, there).alias("present"), F.filter(wanted, lambda k: ~there(k)).alias("missing"))


def is_technical(token: Column) -> Column:
    """By list, hyphen, capitals, digit or ending."""
    low = F.lower(token)
    endings = low.rlike("(?:" + "|".join(TECH_ENDINGS) + ")$")
    capitals = (F.upper(token) == token) & (low != token) & (F.length(token) >= 2)
    return low.isin(*TECHNOLOGIES) | F.contains(token, F.lit("-")) | capitals | token.rlike("[0-9]") | endings


def format_issues(text: Column) -> Column:
    """What makes a text hard to read by machines, as a list of messages."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    lines = F.split(text, "\n")  # line by line: patterns that begin anywhere in a long line take the square of its length
    low = F.lower(text)
    # Written out section by section: within a lambda, the lower-cased text would be made anew for each.
    stated = lambda held: F.filter(F.array(*(F.when(F.contains(low, F.lit(s)) == held, s) for s in sorted(SECTIONS))), lambda s: s.isNotNull())
    found, missing = stated(F.lit(True)), stated(F.lit(False))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    issues = F.array(
        F.when(n < 200, say("too sparse: ", n.cast("string"), " words")).when(n > 1200, say("too long: ", n.cast("string"), " words")),
        F.when(F.size(found) < 3, say("sections found: ", F.size(found).cast("string"), "; missing: ", F.array_join(missing, ", "))),
        F.when(F.exists(lines, lambda x: F.contains(F.btrim(x, F.lit(" \t\r\f\v")), F.lit("\t\t"))), "columns: tabs within a line"),
        F.when(F.exists(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2), "table: pipes within a line"),
        F.when(F.exists(lines, lambda x: x.rlike(r"(?i)\bpage\s+\d+\s+of\s+\d+\b|^\s*-\s*\d+\s*-\s*$")), "page number"),
    )
    return F.filter(issues, lambda i: i.isNotNull())


def json_in(text: Column) -> Column:
    """From the first brace to the last, if that is JSON."""
    part = F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?\\s*", ""), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(part).isNotNull(), part)


def identity_hash(*parts: Column) -> Column:
    """32-bit hash h * 33 + code over the characters of the parts joined by |, in hexadecimal."""
    codes = F.transform(F.filter(F.split(F.concat_ws("|", *parts), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.hex(value))


def class_fingerprint(classes: Column) -> Column:
    """The first 16 digits of the hash of a page's distinct classes in order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(classes)), "|"), 256), 1, 16)


def normal_label(label: Column) -> Column:
    """Lower case, letters and digits of ASCII, single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[*✱]", ""), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def id_stem(field_id: Column, denied: list[str] = ()) -> Column:
    """An id without its number; null if it is empty or generic, with or without the prefix form-."""
    stem = F.regexp_replace(F.lower(F.trim(field_id)), r"[-_]{1,2}\d+$", "")
    generic = stem.isin(*denied) | F.regexp_replace(stem, "^form-", "").isin(*denied) if denied else F.lit(False)
    return F.when((stem != "") & ~generic, stem)


def option_set(options: Column, generic: list[list[str]] = ()) -> Column:
    """At least three distinct options, lower-cased and sorted; null for sets that say nothing."""
    norm = F.array_sort(F.array_distinct(F.filter(F.transform(options, lambda o: F.lower(F.trim(o))), lambda o: o != "")))
    plain = F.array_join(norm, "\x1f").isin(*("\x1f".join(sorted(g)) for g in generic)) if generic else F.lit(False)
    return F.when((F.size(options) >= 3) & (F.size(norm) >= 3) & ~plain, norm)


def days_since(posted_ms: Column, now: Column) -> Column:
    """Whole days, none below 0; 0 and null are no date."""
    days = F.floor((F.unix_millis(now) - posted_ms) / F.lit(86400000))
    return F.when(posted_ms.isNotNull() & (posted_ms != 0), F.greatest(days, F.lit(0).cast("long")))


def relative_time(posted_ms: Column, now: Column) -> Column:
    """X27."""
    s = F.floor(F.unix_millis(now) / 1000) - F.floor(posted_ms / 1000)
    count = lambda unit, size: F.concat(F.floor(s / size).cast("string"), F.lit(f" {unit}"), F.when(F.floor(s / size) == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(posted_ms.isNull() | (posted_ms == 0) | (s < 60), "just now").when(s < 3600, count("minute", 60)).when(s < 86400, count("hour", 3600)).otherwise(count("day", 86400))
    )


def salary_midpoint(text: Column) -> Column:
    """The middle of the first range of dollars, halves up."""
    part = lambda k: F.replace(F.regexp_extract(text, r"\$(\d[\d,]*)\s*[-–—]\s*\$(\d[\d,]*)", k), F.lit(","), F.lit("")).try_cast("long")
    return F.when((part(1) > 0) & (part(2) > 0), F.floor((part(1) + part(2)) / 2 + 0.5))


#: Grade averages by band and the ways a form may name it.
GRADE_BANDS = [(3.5, ["3.5-4.0", "3.5+", "above 3.5"]), (3.0, ["3.0-3.49", "3.0+", "above 3.0"]), (2.5, ["2.5-2.99", "2.5+"]), (0.0, ["below 2.5"])]


def grade_synonyms(grade: Column) -> Column:
    """The names of the band that a grade average falls in."""
    out = F
    for least, names in GRADE_BANDS:
        out = out.when(grade >= least, F.array(*map(F.lit, names)))
    return out.otherwise(F.lit(None).cast("array<string>"))


class _Text(HTMLParser):
    def __init__(self, skip: tuple[str, ...]):
        super().__init__()
        self.skip, self.off, self.parts, self.link, self.links = skip, 0, [], None, []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.off += tag in self.skip
        if tag == "a":
            self.link = dict(attrs).get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip and self.off:
            self.off -= 1
        if tag == "a":
            self.link = None

    def handle_data(self, data: str) -> None:
        if not self.off and data.strip():
            self.parts.append(data.strip())
        if self.link is not None:
            self.links.append((data, self.link))


def _read(page: str | None, skip: tuple[str, ...] = ()) -> _Text:
    parser = _Text(skip)
    parser.feed(page or "")
    parser.close()
    return parser


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """All text of pages, a line for each piece, blank lines at most two in a row."""
    return pages.map(lambda p: re.sub(r"\n{3,}", "\n\n", "\n".join(_read(p).parts)).strip())


@F.pandas_udf(T.StringType())
def escaped_page_text(pages: pd.Series) -> pd.Series:
    """X7 for a source that escapes its markup."""
    return pages.map(lambda p: "\n".join(_read(html_entities.unescape(p or "")).parts).strip())


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """Text outside of script and style, white space collapsed."""
    return pages.map(lambda p: re.sub(r"\s+", " ", " ".join(_read(p, ("script", "style")).parts)).strip())


def link_named(phrase: str):
    """Where the first link leads whose text holds the phrase; empty without."""

    @F.pandas_udf(T.StringType())
    def find(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: next((href for text, href in _read(p).links if phrase in text), ""))

    return find


@F.pandas_udf(T.StringType())
def display_name(slugs: pd.Series) -> pd.Series:
    """Hyphens to spaces, a capital after every character that isn't a letter, as in 3D Systems."""
    return slugs.map(lambda s: None if s is None else s.replace("-", " ").title())


#: Headings that begin a skills section, and other sections' headings.
SKILL_HEADINGS = ["skills", "technologies", "tech stack", "tools", "technical skills"]
OTHER_HEADINGS = [
    "experience", "education", "work history", "employment", "projects", "certifications", "awards", "publications", "interests", "volunteer", "objective", "summary", "profile",
    "achievements", "languages", "hobbies", "references", "activities",
]


def _heading(line: str, names: list[str]) -> bool:
    line = line.strip()
    return bool(line) and len(line) <= 80 and any(n in line.lower() for n in names)


def inject(text: str, terms: list[str]) -> str:
    """The terms at the end of the skills section; without one, a section of their own at the end."""
    if not terms:
        return text
    lines, added = text.splitlines(), ", ".join(terms)
    at = next((i for i, line in enumerate(lines) if _heading(line, SKILL_HEADINGS)), None)
    if at is None:
        return f"{text.rstrip()}\n\nSkills\n{added}\n"
    head, _, inline = lines[at].partition(":")
    if inline.strip():
        lines[at] = f"{lines[at].rstrip()}, {added}"
        return "\n".join(lines)
    end = next((i for i in range(at + 1, len(lines)) if _heading(lines[i].rstrip(":- "), OTHER_HEADINGS)), len(lines))
    filled = [i for i in range(at + 1, end) if lines[i].strip()]
    if not filled:
        lines.insert(at + 1, added)
    else:
        last = lines[filled[-1]].rstrip()
        lines[filled[-1]] = last + (" " if last.endswith(",") else ", ") + added
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def inject_keywords(texts: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([inject(t or "", list(k) if k is not None else []) for t, k in zip(texts, terms)])


def rewrite(text: str, changes: list[tuple[str, str]]) -> str:
    """Each bullet's first place gets its new wording; one that isn't found is sought without its mark."""
    for old, new in changes:
        if old in text:
            text = text.replace(old, new, 1)
        elif bare := old.lstrip("-•*– ").strip():
            text = re.sub(r"(?m)^([\s\-•*–]+)" + re.escape(bare), lambda m, new=new: m[1] + new, text, count=1)
    return text


@F.pandas_udf(T.StringType())
def apply_rewrites(texts: pd.Series, changes: pd.Series) -> pd.Series:
    """changes: array of (old, new)."""
    return pd.Series([rewrite(t or "", [(c["old"], c["new"]) for c in (k if k is not None else [])]) for t, k in zip(texts, changes)])
