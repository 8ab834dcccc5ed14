"""Classification cascades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.functions.places import lookup
from corvane.operators.merge import first_of

#: Trust in a signal by the tier that gives it.
CONFIDENCE = {"autocomplete": 0.95, "id": 0.9, "label": 0.8, "placeholder": 0.6, "section": 0.4, "nearby_text": 0.35}
LEAST_TEXT = 15

#: Standard autocomplete tokens and what they ask for.
AUTOCOMPLETE = {
    "given-name": "first_name", "family-name": "last_name", "name": "full_name", "nickname": "preferred_name", "email": "email", "tel": "phone", "tel-national": "phone",
    "tel-country-code": "phone", "tel-area-code": "phone", "tel-local": "phone", "street-address": "location_address", "address-line1": "location_address",
    "address-line2": "location_address", "address-level1": "location_state", "address-level2": "location_city", "postal-code": "location_zip", "country": "location_country",
    "country-name": "location_country", "url": "portfolio",
}

#: What ids ask for, first match first.
ID_RULES = [
    ("first_name", ["first_?name|fname"], []), ("last_name", ["last_?name|lname"], []), ("email", ["email"], []), ("phone", ["phone|mobile"], []),
    ("linkedin", ["linkedin"], []), ("github", ["github"], []), ("cover_letter", ["cover_?letter"], []),
]

#: What labels ask for, (name, patterns, exclusions), first match first.
LABEL_RULES = [
    ("first_name", [r"first.?name", r"given.?name"], [r"last", r"preferred", r"emergency", r"reference"]),
    ("last_name", [r"last.?name", r"surname", r"family.?name"], [r"first", r"emergency", r"reference"]),
    ("full_name", [r"^name$", r"full.?name", r"your name"], [r"first", r"last", r"preferred", r"company"]),
    ("email", [r"e-?mail"], [
        r"confirm", r"emergency", r"reference", r"sms", r"whatsapp", r"newsletter", r"recruitment notif", r"job openings", r"gdpr", r"controller of personal data"]),
    ("phone", [r"\bphone\b", r"mobile", r"\btel\b"], [r"emergency", r"fax", r"reference", r"sms", r"whatsapp"]),
    ("linkedin", [r"linked.?in"], []),
    ("github", [r"git.?hub"], []),
    ("portfolio", [r"portfolio", r"personal.?site", r"\bwebsite\b"], [r"company", r"employer"]),
    ("location_city", [r"\bcity\b", r"\btown\b"], [r"country", r"state", r"zip", r"postal"]),
    ("location_state", [r"\bstate\b", r"\bprovince\b"], [r"country", r"city", r"zip", r"government", r"employee"]),
    ("location_country", [r"\bcountry\b"], [r"city", r"state", r"authoriz", r"eligib", r"legally", r"sponsor"]),
    ("location_address", [r"street.?address", r"\baddress\b"], [r"city", r"state", r"country", r"zip", r"sms"]),
    ("location_zip", [r"\bzip\b", r"postal.?code"], []),
    ("preferred_name", [r"preferred.{0,10}name", r"goes.?by", r"nickname"], []),
    ("pronouns", [r"pronoun"], []),
    ("work_authorized", [
        r"legally authorized", r"authorized to work", r"eligible to work", r"right to work", r"permitted to work", r"us citizen or.*green card", r"citizen or permanent"], [
        r"sponsor", r"explain", r"detail", r"describe", r"status", r"type", r"visa", r"long.?term", r"without sponsorship", r"permanent"]),
    ("work_authorized_longterm", [
        r"long.?term", r"without sponsorship", r"permanent.*auth", r"eligible.*long", r"work.*without.*requiring", r"citizen or permanent resident"], [
        r"sponsor.*require", r"explain", r"detail", r"describe", r"disab", r"impairment", r"health condition"]),
    ("needs_sponsorship", [
        r"require.*sponsor", r"need.*sponsor", r"visa sponsor", r"immigration support", r"immigration assistance", r"work authorization support",
        r"now or in the future.*sponsor", r"sponsor.*now or in the future"], [r"explain", r"detail", r"describe", r"list"]),
    ("visa_status", [
        r"visa status", r"work authorization status", r"immigration status", r"current.*visa", r"type of.*visa", r"type of.*authorization", r"work auth.*type"], [
        r"now or in the future", r"will you require", r"require.*sponsor"]),
    ("immigration_explanation", [
        r"explain.*work auth", r"describe.*visa", r"detail.*immigration", r"work authorization.*detail", r"please (explain|describe).*(auth|visa|immigration)", r"additional.*immigration",
        r"immigration.*information", r"immigration support.*if yes", r"if yes.*please list", r"need.*immigration support.*detail"], []),
    ("eeo_gender", [r"\bgender\b", r"gender identity"], [r"race", r"ethnicity", r"veteran", r"disability"]),
    ("eeo_race", [r"\brace\b", r"racial", r"ethnicity", r"identify your race"], [r"gender", r"veteran", r"disability", r"hispanic"]),
    ("eeo_hispanic", [r"hispanic", r"latino"], []),
    ("eeo_veteran", [r"veteran", r"military", r"armed forces", r"protected veteran"], [r"disability", r"gender", r"government", r"civilian"]),
    ("eeo_disability", [r"disability", r"disabled", r"disability status"], [r"veteran", r"gender"]),
    ("school", [r"\bschool\b", r"\buniversity\b", r"\bcollege\b", r"institution", r"alma mater"], [r"degree", r"major", r"gpa", r"high school"]),
    ("degree", [r"\bdegree\b", r"degree type", r"level of education", r"highest.*education", r"education level"], [r"school", r"major", r"field", r"discipline"]),
    ("major", [r"\bmajor\b", r"field of study", r"\bdiscipline\b", r"concentration", r"area of study"], [r"school", r"degree"]),
    ("gpa", [r"\bgpa\b", r"grade point", r"cumulative.*grade"], []),
    ("graduation_date", [r"graduation", r"grad.?date", r"expected.*grad", r"end date", r"completion date", r"graduate.*when"], []),
    ("compensation", [r"compensation", r"\bsalary\b", r"\bpay\b", r"hourly", r"\bwage\b", r"pay expectation"], [r"equity", r"bonus", r"benefit"]),
    ("start_date", [r"when can you start", r"available to start", r"start date", r"earliest.*start"], [r"internship", r"term"]),
    ("years_experience", [r"years.*experience", r"experience.*years", r"how many years"], []),
    ("internship_duration", [r"how long.*internship", r"internship.*duration", r"internship.*length", r"length.*internship"], []),
    ("internship_start", [r"start.*internship", r"internship.*start", r"when.*start.*intern", r"term.*start", r"internship.*term"], []),
    ("internship_field", [r"^what field.*internship", r"^internship.*field", r"^area.*internship", r"^internship.*area"], []),
    ("previously_employed", [r"previously employed", r"worked (here|with us|for us)", r"former.*employee", r"worked for.*company", r"ever.*(been employed|worked)"], []),
    ("referral", [r"who referred", r"\breferral\b", r"referred by"], [r"hear about", r"learn about"]),
    ("cover_letter", [r"cover.?letter"], []),
    ("transcript_undergrad", [r"undergrad(uate)?.*transcript", r"transcript.*undergrad(uate)?", r"unofficial.*transcript", r"^transcript$"], [r"grad(uate)?(?!.*under)"]),
    ("transcript_grad", [r"grad(uate)?.*transcript", r"transcript.*grad(uate)?", r"graduate.*transcript"], [r"undergrad", r"unofficial"]),
]

#: Labels that ask for a consent; they come after the others.
CONSENT_RULES = [
    ("consent_background_check", [r"background check", r"criminal background", r"criminal history check", r"consent.*prior employer"], [r"condition of employment.*willing to submit"]),
    ("consent_privacy_policy", [r"privacy policy", r"privacy disclosure", r"use.*personal data.*recruitment", r"privacy acknowledg"], [
        r"consent to receive text messages", r"provide the personal information of a third party"]),
    ("consent_gdpr_notice", [r"\bgdpr\b", r"data protection regulation", r"controller of personal data"], []),
    ("consent_sms_communication", [
        r"(sms|text message|whatsapp).{0,60}(consent|allow|contact|update)", r"(consent|allow|contact|update).{0,60}(sms|text message|whatsapp)"], []),
    ("marketing_communications_optin", [
        r"(future recruitment|job openings|marketing|newsletter).{0,60}(email.*me|notify|subscribe)", r"(email.*me|notify|subscribe).{0,60}(future recruitment|job openings|marketing|newsletter)"], []),
    ("consent_demographic_survey", [
        r"(voluntar|confidential).{0,80}(demographic|diversity).{0,40}survey", r"(demographic|diversity).{0,40}survey.{0,80}(voluntar|confidential|participat)"], [
        r"\b(gender|race|racial|ethnicity|hispanic|latino|veteran|disability)\b"]),
]

#: Topics that labels and placeholders are tried for last; a topic that nothing supports gives nothing.
ADDED_TOPICS = [
    ("resume_upload", [r"^resume$", r"resume.?/.?cv", r"upload.*resume", r"\bcv\b"], [r"cover"]),
    ("how_heard_about_role", [r"how did you (hear|learn|find out)", r"where did you (hear|learn|find out)"], [r"referral", r"referred by"]),
    ("consent_background_check", [r"background check", r"background investigation"], []),
    ("eeo_veteran_status", [r"protected veteran status"], []),
]

#: Rules from which on texts meet them by an index of their literals.
INDEX_FROM = 200

#: Labels of fields that ask on from the one before.
FOLLOW_UP = r"(?i)^(if (you selected |applicable,? )?other,?\s*(above,?\s*)?please (specify|explain|elaborate)|if (yes|applicable),?\s*please (explain|list|describe))"

#: Hidden inputs that track where a visitor came from.
TRACKING_IDS = ["gclid", "ft_source", "ft_campaign", "lt_source", "lead_source", "gaclientid"]


def interpret(fields: DataFrame, label_rules: list | None = None) -> DataFrame:
    """What a form field asks for, by the first tier that knows, or what to do with one that asks for nothing.

    fields has tag, itype, id, ac, label, placeholder, section, nearby, req. Each tier is a column of its own, so no
    generated method grows with the whole table of rules; label_rules may be of any length, as from INDEX_FROM rules on
    texts meet them by an index. Adds category, confidence, tier, action.
    """
    last = [(CAPABILITIES[topic], patterns, exclusions) for topic, patterns, exclusions in ADDED_TOPICS if topic in CAPABILITIES]
    table = label_rules or LABEL_RULES + CONSENT_RULES
    longer = table if label_rules else table + last
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    label, placeholder, own_id = F.trim(text("label")), F.trim(text("placeholder")), F.lower(F.trim(text("id")))
    stem = F.regexp_replace(own_id, r"[-_]{1,2}\d+$", "")
    generic = (label == "") | F.lower(label).isin("select", "select...")
    tracking = F.exists(F.array(*map(F.lit, TRACKING_IDS)), lambda t: F.contains(own_id, t))
    say = lambda action, tier, confidence: F.struct(F.lit(action).alias("action"), F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))
    structural = (
        F.when((own_id == "edit-url") | label.rlike("(?i)leave this field blank"), say("skip", "honeypot", 1.0))
        .when((F.col("itype") == "hidden") & tracking, say("skip", "hidden_tracking_field", 0.9))
        .when(F.col("itype") == "hidden", say("skip", "hidden_non_interactive_field", 0.9))
        .when(generic & (placeholder == "") & (F.col("itype") == "text") & F.coalesce("req", F.lit(False)), say("self_resolves", "react_select_required_shim", 0.9))
        .when(label.rlike(FOLLOW_UP), say("resolve_from_preceding_field", "other_followup", 0.85))
    )
    silent = (label == "") & (placeholder == "")
    long_enough = lambda c: F.length(F.trim(text(c))) >= LEAST_TEXT
    tiers = {
        "autocomplete": lookup(AUTOCOMPLETE, F.lower(F.trim(text("ac")))),
        "id": rules.first_matching(stem, ID_RULES),
        "label": (F.when(label != "", F.lower(text("label"))), longer),
        "placeholder": (F.when((label == "") & (placeholder != ""), F.lower(text("placeholder"))), longer),
        "section": (F.when(silent & long_enough("section"), F.lower(text("section"))), table),
        "nearby_text": (F.when(silent & long_enough("nearby"), F.lower(text("nearby"))), table),
    }
    staged = fields.withColumn("__structural", structural)
    for name, tier in tiers.items():
        if not isinstance(tier, tuple):
            staged = staged.withColumn(f"__{name}", tier)
        elif len(tier[1]) < INDEX_FROM:
            staged = staged.withColumn(f"__{name}", rules.first_matching(*tier))
        else:
            staged = rules.with_first_indexed(staged, tier[0], tier[1], f"__{name}")
    plain = F.col("__structural").isNull()
    category = F.when(plain, F.coalesce(*(F.col(f"__{n}") for n in tiers)))
    tier, confidence = F, F
    for name in tiers:
        hit = F.col(f"__{name}").isNotNull()
        tier, confidence = tier.when(hit, name), confidence.when(hit, CONFIDENCE[name])
    return staged.select(
        *fields.columns, category.alias("category"), F.when(plain, confidence.otherwise(F.lit(0.0))).otherwise(F.col("__structural.confidence")).alias("confidence"),
        F.when(plain, tier.otherwise(F.lit(None).cast("string"))).otherwise(F.col("__structural.tier")).alias("tier"), F.col("__structural.action").alias("action"),
    )


#: Topics of forms by what answers them; the names of those that nothing answers are in UNSUPPORTED.
CAPABILITIES = {
    "first_name": "first_name", "last_name": "last_name", "preferred_first_name": "preferred_name", "email": "email", "phone": "phone", "linkedin_url": "linkedin",
    "github_url": "github", "personal_website": "portfolio", "location_city": "location_city", "state": "location_state", "street_address": "location_address",
    "zip_code": "location_zip", "country_of_residence": "location_country", "mailing_address": "location_address", "preferred_pronouns": "pronouns",
    "work_authorized": "work_authorized", "needs_sponsorship": "needs_sponsorship", "citizenship_status": "work_authorized_longterm", "currently_based_in_country": "location_country",
    "visa_type": "visa_status", "eeo_gender_identity": "eeo_gender", "eeo_race_ethnicity": "eeo_race", "eeo_hispanic_latino": "eeo_hispanic", "eeo_veteran_status": "eeo_veteran",
    "eeo_disability_status": "eeo_disability", "education_school": "school", "education_degree": "degree", "education_discipline": "major", "education_end_date": "graduation_date",
    "graduation_date": "graduation_date", "academic_grade": "gpa", "salary_expectation": "compensation", "availability_start_date": "start_date", "skill_experience_years": "years_experience",
    "current_employee_of_company": "previously_employed_here", "previously_employed_here": "previously_employed", "employee_referral": "referral", "cover_letter_upload": "cover_letter",
    "consent_background_check": "consent_background_check", "consent_sms_communication": "consent_sms_communication", "consent_demographic_survey": "consent_demographic_survey",
    "marketing_communications_optin": "marketing_communications_optin", "consent_privacy_policy": "consent_privacy_policy", "consent_gdpr_notice": "consent_gdpr_notice",
}
UNSUPPORTED = [
    "phone_country_code", "name_pronunciation", "intended_work_country", "country_of_origin", "nationality", "nationality_check", "national_id_number", "current_country_id_number",
    "export_control", "security_clearance", "skillbridge_eligibility_date", "eeo_sexual_orientation", "eeo_transgender", "eeo_generic_decline_option", "field_of_study_relevance",
    "education_start_date", "standardized_test_score", "currently_enrolled_status", "current_school_year", "courses_remaining", "certifications", "compensation_range_acknowledgment",
    "current_salary", "current_benefits", "competing_offers_disclosure", "notice_period", "contract_length", "employment_type", "workplace_type", "availability_end_date",
    "availability_days", "availability_hours_per_week", "availability_commitment_confirmation", "interview_availability", "travel_willingness", "willing_to_relocate",
    "relevant_industry_experience", "technical_skills", "language_proficiency", "qualifications_confirmation", "writing_sample_request", "publication_list", "current_job_title",
    "current_company", "currently_employed_elsewhere", "previously_applied_here", "how_heard_about_role", "resume_upload", "consent_attestation_general", "consent_ccpa_share_sale",
    "ccpa_california_disclosure", "criminal_background_disclosure", "nepotism_disclosure", "pep_disclosure", "age_18_or_older", "location_preference", "department_interest",
    "work_history_employer", "work_history_title", "work_history_start_date", "work_history_end_date", "military_branch", "military_rank", "military_specialty_code",
    "military_time_in_service", "military_separation_date", "essay", "attention_check", "agency_preference", "competition_participation", "event_attendance",
    "internship_agreement_confirmation", "preferred_contact_method", "program_affiliation", "scholarship_program_affiliation", "student_org_involvement", "ai_tool_usage_disclosure",
]

#: Consent topics with the default answer, and the wordings of an answer, the first one preferred.
CONSENT_DEFAULTS = {
    "consent_background_check": "accept", "consent_privacy_policy": "accept", "consent_gdpr_notice": "accept", "consent_sms_communication": "decline",
    "marketing_communications_optin": "decline", "consent_demographic_survey": "decline",
}
CONSENT_WORDINGS = {
    "accept": ["Yes", "I agree", "I consent", "Accept", "I understand and agree"],
    "decline": ["No", "I do not consent", "Decline", "I don't wish to", "Prefer not to"],
}

#: Kinds of visa, (may work now, may work for long).
VISA_WORK = {
    "F1": ("Yes", "No"), "F1_OPT": ("Yes", "No"), "F1_STEM_OPT": ("Yes", "No"), "J1": ("Yes", "No"), "H1B": ("Yes", "Yes"), "H4_EAD": ("Yes", "No"), "L1": ("Yes", "No"),
    "O1": ("Yes", "No"), "TN": ("Yes", "No"), "E3": ("Yes", "No"), "US_CITIZEN": ("Yes", "Yes"), "GREEN_CARD": ("Yes", "Yes"), "CONDITIONAL_GC": ("Yes", "Yes"), "PENDING_GC_EAD": ("Yes", "No"),
    "ASYLUM_EAD": ("Yes", "No"), "DACA": ("Yes", "No"), "NON_IMMIGRANT": ("Yes", "No"), "OTHER": ("Yes", "No"), "PREFER_NOT": ("Yes", "No"),
}
#: How forms word each kind of visa, the first wording preferred.
VISA_WORDINGS = {
    "F1": ["F1", "F-1", "F1/CPT", "F-1/CPT", "F1 (CPT)", "F-1 (CPT)", "Student Visa", "Student (F-1)", "F1 Student", "F-1 Student", "F1/OPT", "F-1/OPT", "F1 Visa", "F-1 Visa"],
    "F1_OPT": ["OPT", "F1 OPT", "F-1 OPT", "Optional Practical Training", "Post-graduation OPT", "F-1 (OPT)", "F1 (OPT)"],
    "F1_STEM_OPT": ["STEM OPT", "F1 STEM OPT", "F-1 STEM OPT", "STEM Extension", "OPT STEM", "STEM OPT Extension"],
    "J1": ["J1", "J-1", "J1 Visa", "J-1 Visa", "Exchange Visitor", "J-1 (Academic Training)", "J1 (Academic Training)"],
    "H1B": ["H1B", "H-1B", "H1-B", "H1B Visa", "H-1B Visa", "H1B Sponsored"],
    "H4_EAD": ["H4 EAD", "H-4 EAD", "H4", "H-4", "EAD (H4)", "H-4 (EAD)"],
    "L1": ["L1", "L-1", "L1 Visa", "L-1 Visa", "Intracompany Transfer"],
    "O1": ["O1", "O-1", "O1 Visa", "O-1 Visa", "Extraordinary Ability"],
    "TN": ["TN", "TN Visa", "TN Status", "Trade NAFTA", "TN (NAFTA/USMCA)"],
    "E3": ["E3", "E-3", "E3 Visa", "E-3 Visa", "Australian"],
    "US_CITIZEN": ["US Citizen", "U.S. Citizen", "Citizen", "United States Citizen", "American Citizen", "USC", "US Citizen / Permanent Resident"],
    "GREEN_CARD": ["Green Card", "Permanent Resident", "LPR", "PR", "Lawful Permanent Resident", "I-551", "Permanent Resident (Green Card)"],
    "CONDITIONAL_GC": ["Conditional Green Card", "Conditional Permanent Resident", "I-551 (Conditional)", "Conditional LPR"],
    "PENDING_GC_EAD": ["EAD", "Pending Green Card", "Adjustment of Status", "EAD (Pending GC)", "I-485 EAD", "Pending Permanent Residence"],
    "ASYLUM_EAD": ["Asylum", "Refugee", "EAD (Asylum)", "EAD (Refugee)", "Asylee", "Refugee Status", "Asylum/Refugee"],
    "DACA": ["DACA", "DACA/EAD", "Deferred Action", "DACA Recipient"],
    "NON_IMMIGRANT": ["Non-immigrant Visa", "Non-immigrant", "Visa Holder", "Sponsored Worker", "Working Holiday", "Working Holiday Visa"],
    "OTHER": ["Other", "Other Visa", "Not Listed", "Other Status", "Other Authorization"],
    "PREFER_NOT": ["Prefer not to say", "Prefer not to answer", "Decline to answer", "Choose not to answer", "Decline to Self Identify"],
}


def visa_answers(visa: Column) -> Column:
    """(now, longterm, wordings) of a kind of visa; one that isn't listed is OTHER."""
    known = lambda table, of: F.coalesce(lookup({k: of(v) for k, v in table.items()}, visa), F.lit(of(table["OTHER"])))
    wordings = F.coalesce(*(F.when(visa == k, F.array(*map(F.lit, v))) for k, v in VISA_WORDINGS.items()), F.array(*map(F.lit, VISA_WORDINGS["OTHER"])))
    return F.struct(known(VISA_WORK, lambda v: v[0]).alias("now"), known(VISA_WORK, lambda v: v[1]).alias("longterm"), wordings.alias("wordings"))


def consent_answer(topic: Column) -> Column:
    """The wordings of a consent topic's default answer, the preferred one first; null for other topics."""
    return F.coalesce(*(F.when(lookup(CONSENT_DEFAULTS, topic) == side, F.array(*map(F.lit, words))) for side, words in CONSENT_WORDINGS.items()))


def capability(category: Column, table: dict[str, str] | None = None, unsupported: list[str] | None = None) -> Column:
    """What answers a topic; null for those that nothing supports and for unknown ones."""
    return F.when(~category.isin(*(UNSUPPORTED if unsupported is None else unsupported)), lookup(CAPABILITIES if table is None else table, category))


def topic_status(category: Column) -> Column:
    """Supported, unsupported or unknown."""
    return F.when(category.isin(*UNSUPPORTED), "unsupported").when(category.isin(*CAPABILITIES), "supported").otherwise("unknown")


def discover(staged: DataFrame, companies: DataFrame) -> DataFrame:
    """What becomes of a staged posting: already_known by name or slug, added, or queued with its reason.

    staged: id, company_name, candidates, domain, career_url, ats, slug; companies: company_id, company_name, slug.
    """
    by_name = companies.groupBy(F.lower("company_name").alias("__name")).agg(F.min("company_id").alias("__by_name"))
    by_slug = companies.groupBy(F.col("slug").alias("__slug")).agg(F.min("company_id").alias("__by_slug"))
    tried = staged.select("id", F.explode_outer("candidates").alias("__slug")).join(by_slug, "__slug").groupBy("id").agg(F.min("__by_slug").alias("__by_slug"))
    joined = staged.withColumn("__name", F.lower("company_name")).join(by_name, "__name", "left").join(tried, "id", "left")
    known = F.coalesce("__by_name", "__by_slug")
    slug = F.coalesce("slug", F.get("candidates", F.lit(0)))
    polled = F.col("ats").isin("ashby", "greenhouse", "lever", "smartrecruiters")
    result = F.when(known.isNotNull(), "already_known").when(polled & slug.isNotNull() & F.col("career_url").isNotNull(), "added").otherwise("queued_manual")
    bucket = F.when(F.col("domain").isNull() | F.col("career_url").isNull() | F.col("ats").isNull(), "unknown_ats").otherwise("known_ats_unclear_slug")
    return joined.select("id", result.alias("result"), known.alias("company_id"), F.when(result == "queued_manual", bucket).alias("bucket"), F.when(result == "added", slug).alias("slug"))


def classify_once(rows: DataFrame, text: str, classify: Callable[[Column], Column], cache: DataFrame | None = None) -> DataFrame:
    """Every distinct text is classified once, and not at all if the cache (hash, label) has it."""
    hashed = rows.withColumn("hash", F.sha2(F.lower(F.trim(text)), 256))
    distinct = hashed.groupBy("hash").agg(F.min(text).alias("__text"))
    if cache is not None:
        distinct = distinct.join(cache.select("hash"), "hash", "left_anti")
    made = distinct.select("hash", classify(F.col("__text")).alias("label"))
    known = made if cache is None else made.unionByName(cache.select("hash", "label"))
    return hashed.join(known, "hash", "left")


def route_fix(reason: Column, category: Column, term: Column, guarded: Column) -> Column:
    """What a cluster of failures gets: a proposed fix, a human's decision, or no general fix."""
    return (
        F.when(~reason.isin("CLASSIFICATION_NO_MATCH", "CLASSIFICATION_WRONG_MATCH"), "no_generalized_fix")
        .when(F.coalesce(category, F.lit("")) == "", "needs_human_decision")
        .when(term.isNull(), "no_generalized_fix")
        .when(~guarded, "needs_human_decision")
        .otherwise("proposed_fix")
    )


def decided(decisions: DataFrame) -> DataFrame:
    """C11: (key, action, value, source_rank, in_original) to the decisions that hold: a key that the original table has
    keeps those; else, within one action, the later file wins. A key may hold several actions; look-up order settles it."""
    original = decisions.where("in_original")
    later = decisions.where("NOT in_original").join(original.select("key"), "key", "left_anti")
    return first_of(original.unionByName(later), ["key", "action"], [F.desc("source_rank")])


def harness_outcome(phase: Column, verified: Column, failures: Column, blocked: Column) -> Column:
    """A page block overrides all; verified by itself but empty on the page is a failure."""
    return (
        F.when(blocked, "skipped_blocked").when(phase == "timeout", "timeout").when(phase == "no_job", "no_job_available")
        .when(verified & (failures > 0), "failed").when(verified, "mechanically_verified").when(phase == "awaiting_review", "needs_review_non_submit").otherwise("failed")
    )


def attempts_in_log(lines: Column) -> Column:
    """Log lines "category=... label=... status=..." as structs; other lines are skipped."""
    pattern = r"category=(\S+) label=(.*?) status=(\S+)"
    own = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(own, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("category"), F.regexp_extract(x, pattern, 2).alias("label"), F.regexp_extract(x, pattern, 3).alias("status")))
