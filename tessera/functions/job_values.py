"""Fixed values of the job rules: role, stack and experience patterns, word lists, orders of precedence. Nothing here is computed.

Patterns are read without regard to case, by Java's and Python's expressions alike, but where it says otherwise.
"""

# Patterns of target roles, on titles in lower case without accents.
RELEVANT_ROLES = {
    "software developer": r"\bsoftware developer\b",
    "software engineer": r"\bsoftware engineer(?:\s+i)?\b",
    "full stack developer": r"\bfull[ -]?stack\b(?:\s+[().&+#\w-]+){0,5}\s+(?:developers?|engineers?)\b",
    "frontend developer": r"\bfront[ -]?end(?:\s+[.&+#\w-]+){0,3}\s+(?:developers?|engineers?)\b",
    "backend developer": r"\bback[ -]?end (?:developers?|engineers?)\b",
    "web developer": r"\bweb developers?\b",
    "technology developer": r"\b(?:ai|artificial intelligence|machine learning|ml|java|python|php|laravel|javascript|typescript|react(?:\.?js)?|next(?:\.js|js)|node(?:\.js|js)|nest(?:\.js|js)|fastapi|django|angular|\.net|dotnet) (?:developers?|engineers?)\b",
    "programmer": r"\b(?:(?:software|java|python|php|javascript|typescript) )?programmers?\b",
    "cloud developer": r"\bcloud developers?\b",
    "developpeur": r"\bdeveloppeu(?:r|se)s?\b",
    "developpeur logiciel": r"\bdeveloppeu(?:r|se)s? logiciel(?:le)?s?\b",
    "developpeur web": r"\bdeveloppeu(?:r|se)s? web\b",
    "developpeur full stack": r"\bdeveloppeu(?:r|se)s? full[ -]?stack\b",
    "developpeur backend": r"\bdeveloppeu(?:r|se)s? back[ -]?end\b",
    "developpeur frontend": r"\bdeveloppeu(?:r|se)s? front[ -]?end\b",
}

# Roles that are not wanted; the first that fits counts.
OTHER_ROLES = {
    "REJECT_ROLE_PRODUCT": r"\b(?:product manager|product owner|project manager|scrum master)\b",
    "REJECT_ROLE_CONSULTING": r"\b(?:consultant(?:e|\.e)?s?|consultant\(e\)|value engineer|pre[ -]?sales engineer)(?!\w)",
    "REJECT_ROLE_SALES": r"\b(?:sales|account executive|business development|customer success)\b",
    "REJECT_ROLE_DESIGN": r"\b(?:ux|ui|graphic) designer\b",
    "REJECT_ROLE_NON_SOFTWARE": r"\b(?:(?:ai|ml|machine learning) researcher|security analyst|soc analyst)\b",
    "REJECT_ROLE_QA": r"\b(?:qa|quality assurance|test automation|automation test)\b",
    "REJECT_ROLE_DEVOPS": r"\bdevops\b",
    "REJECT_ROLE_SRE": r"\b(?:sre|site reliability)\b",
    "REJECT_ROLE_NETWORK": r"\bnetwork engineer\b",
    "REJECT_ROLE_IT_SUPPORT": r"\b(?:it support|help[ -]?desk)\b",
    "REJECT_ROLE_DATA": r"\bdata (?:scientist|analyst)\b",
    "REJECT_ROLE_ML_RESEARCH": r"\bmachine learning researcher\b",
    "REJECT_ROLE_EMBEDDED": r"\b(?:embedded|firmware) engineer\b",
    "REJECT_ROLE_SAP": r"\bsap (?:consultant|developer)\b",
    "REJECT_ROLE_SERVICENOW": r"\bservicenow\b",
    "REJECT_ROLE_CYBERSECURITY": r"\bcyber ?security analyst\b",
    "REJECT_ROLE_SYSADMIN": r"\b(?:system|database) administrator\b",
    "REJECT_ROLE_MOBILE_ONLY": r"\b(?:android|ios|mobile) (?:developer|engineer)\b",
}

# Stacks that are not wanted; the first that fits counts. And words of such stacks beside a target role.
OTHER_STACKS = {
    "REJECT_STACK_EMBEDDED_CPP": r"\b(?:embedded|firmware)\b.*\bc\+\+(?!\w)|\bc\+\+(?!\w).*\b(?:embedded|firmware)\b",
    "REJECT_STACK_MAINFRAME_COBOL": r"\b(?:mainframe.*cobol|cobol.*mainframe)\b",
    "REJECT_STACK_SAP_ABAP": r"\b(?:sap.*abap|abap.*sap)\b",
    "REJECT_STACK_SALESFORCE": r"\bsalesforce(?:-only)? (?:developer|engineer)\b",
    "REJECT_STACK_SERVICENOW": r"\bservicenow (?:developer|engineer)\b",
    "REJECT_STACK_UNITY": r"\bunity (?:game )?(?:developer|engineer)\b",
}
MIXED_STACK = r"(?:\bc\+\+(?!\w)|\b(?:cobol|abap|salesforce|servicenow|unity)\b)"

# Levels in titles.
SENIOR = r"(?:\bsenior\b|\bsr\.?\b|\blead\b|\bstaff\b|\bprincipal\b|\barchitect\b|\bhead of engineering\b|\bengineering manager\b|\bdirector\b|\bvp\b|\bchief\b)"
JUNIOR = r"\b(?:junior|graduate|entry[ -]?level|associate)\b|\b(?:software engineer|developer)\s+i\b"

# Technologies.
TECHNOLOGIES = {
    "Python": r"\bpython\b", "FastAPI": r"\bfastapi\b", "Django": r"\bdjango\b",
    "JavaScript": r"\bjavascript\b", "TypeScript": r"\btypescript\b", "React": r"\breact(?:\.js|js)?\b",
    "Next.js": r"\bnext(?:\.js|js)\b", "Node.js": r"\bnode(?:\.js|js)\b", "NestJS": r"\bnest(?:\.js|js)\b",
    "PHP": r"\bphp\b", "Laravel": r"\blaravel\b", "Java": r"\bjava\b",
    "SQL": r"\bsql\b", "PostgreSQL": r"\bpostgres(?:ql)?\b", "MySQL": r"\bmysql\b",
    "MongoDB": r"\bmongodb\b", "Docker": r"\bdocker\b", "REST": r"\brest(?:ful)?\b",
    "OpenAPI": r"\bopenapi\b", "Git": r"\bgit\b",
}

# Numbers in words, and the patterns of stated experience in the order in which they are asked.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5,
    "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
}
NUMBER = r"(?:\d{1,2}|zero|one|two|three|four|five|six|seven|eight|nine|ten|un|une|deux|trois|quatre|cinq|sept|huit|neuf|dix)"
FRENCH_SUFFIX = r"d[\'’ʼ]exp[ée]rience(?:\s+professionnelle)?"
FRENCH_YEARS = r"(?:ann(?:[ée]e|ee)s?|ans?)\b"
FRENCH_RANGE = r"(?:-|–|—|à|a)"
EXPERIENCE = (
    rf"(?P<prefix>minimum(?: of)?|at least)?\s*(?P<min>{NUMBER})\s*(?:(?:-|–|—|to)\s*(?P<max>{NUMBER})\s*)?(?P<plus>\+)?\s*years?(?:\s+of)?(?:\s+(?:professional|relevant|work|industry))?\s+experience|(?P<prefix2>minimum(?: of)?|at least)\s+(?P<min2>{NUMBER})\s+years?",
    rf"\bexp[ée]rience(?:\s+professionnelle)?\s+de\s+(?P<approx>environ\s+)?(?P<min>{NUMBER})\s*(?:{FRENCH_RANGE}\s*(?P<max>{NUMBER})\s*)?{FRENCH_YEARS}(?:\s+minimum)?",
    rf"\bvous\s+(?:(?:justifiez|disposez)\s+(?:de\s+|d[\'’ʼ])|avez\s+)(?P<approx>environ\s+)?(?P<prefix>au\s+moins\s+)?(?P<min>{NUMBER})\s*(?:{FRENCH_RANGE}\s*(?P<max>{NUMBER})\s*)?{FRENCH_YEARS}(?:\s+{FRENCH_SUFFIX})?(?:\s+minimum)?",
    rf"\bentre\s+(?P<min>{NUMBER})\s+et\s+(?P<max>{NUMBER})\s+{FRENCH_YEARS}(?:\s+{FRENCH_SUFFIX})?",
    rf"\b(?P<approx>environ\s+)?(?P<prefix>au\s+moins|un\s+minimum\s+de|minimum(?:\s+de)?)?\s*(?P<min>{NUMBER})\s*(?:{FRENCH_RANGE}\s*(?P<max>{NUMBER})\s*)?{FRENCH_YEARS}(?P<experience>\s+{FRENCH_SUFFIX})?(?P<minimum_after>\s+minimum)?",
    rf"(?P<min>{NUMBER})\s*(?:(?:-|–|—|to)\s*(?P<max>{NUMBER})\s*)?(?P<plus>\+)?\s*years?\s+(?=(?:preferred|desirable|would be (?:a )?plus|is (?:a )?bonus)\b)",
    rf"(?P<min>{NUMBER})\s*(?:(?:-|–|—|to)\s*(?P<max>{NUMBER})|(?P<plus>\+))\s*years?",
)
#: the pattern that counts only if the statement is clear: one of these groups, or a word for an option in its sentence
VAGUE, CLEAR = 4, ("prefix", "max", "experience", "minimum_after")
OPTIONAL = r"\b(?:preferred|nice to have|nice-to-have|bonus|desirable|a plus|id[ée]alement|de pr[ée]f[ée]rence|souhait[ée]e?|serait un plus|un plus|appr[ée]ci[ée]e?)\b"

# Where one may work from.
WORLDWIDE_REMOTE = (
    r"\bremote(?:ly)?\s*(?:[-,:/]\s*)?(?:worldwide|globally|anywhere(?:\s+in the world|(?!\s+(?:in|within|across|throughout)\b))|from anywhere(?:\s+in the world|(?!\s+(?:in|within|across|throughout)\b)))\b"
    r"|\b(?:worldwide|globally)\s*(?:[-,:/]\s*)?remote\b"
    r"|\bwork(?:ing)?\s+(?:remotely\s+)?from anywhere(?:\s+in the world|(?!\s+(?:in|within|across|throughout)\b))\b"
    r"|\bhiring\s+worldwide\s+for\s+(?:a\s+)?remote\b"
    r"|\blocation\s*:\s*(?:remote\s*[-,/]\s*worldwide|worldwide\s*[-,/]\s*remote)\b"
)
CANDIDATES_WORLDWIDE = r"\b(?:open to|hiring)\s+(?:remote\s+)?candidates?\s+worldwide\b"
REMOTE_CONTEXT = r"\bremote\s+(?:role|position|job|work(?:ing)?|candidates?)\b|\b(?:role|position|job|work)\s+(?:is\s+)?remote\b|\bwork(?:ing)?\s+remotely\b|\bwork from home\b|\btelecommut"
WORLDWIDE_LOCATION = r"^(?:remote\s*[-,/]\s*)?(?:worldwide|anywhere(?:\s+in the world)?)(?:\s*[-,/]\s*remote)?$"
EUROPE_PLACE = r"\b(?:europe|eu remote|remote (?:in|within|across) (?:the )?eu)\b"
EUROPE_REMOTE = r"\bremote (?:in|within|across) (?:the )?(?:eu|europe)\b|\b(?:eu|europe)[ -]remote\b"
SPONSORS = r"\b(?:visa sponsorship (?:is )?available|sponsorship available|we (?:can|will) sponsor|relocation (?:is )?(?:available|provided|possible))\b"
NO_SPONSORS = r"\b(?:no (?:visa )?sponsorship|we do not sponsor)\b"
AUTHORISED = r"\b(?:must (?:already )?(?:be )?authorized to work in (?:the )?(?:us|u\.s\.|united states|canada|eu|europe|france|belgium|switzerland|ireland|uk|united kingdom)|must have (?:existing|unrestricted) work authorization(?: in [^.;\n]+)?|(?:eu|us|u\.s\.) citizenship required)\b"
US_ONLY = r"\b(?:us|u\.s\.|united states)[ -]only\b|\bmust reside in (?:the )?(?:us|u\.s\.|united states)\b"
CANADA_ONLY = r"\bcanada residents? only\b"
RELOCATION = r"\brelocation (?:is )?(?:available|provided|possible|offered)\b"
PREFERRED_COUNTRIES = ("France", "Belgium", "Switzerland", "Ireland", "United Kingdom", "Canada")

# Reasons that leave a posting but one step from passing.
MODERATE_GAPS = ("REVIEW_EXPERIENCE_3_YEARS", "REVIEW_EXPERIENCE_PREFERRED", "REVIEW_LOCATION_PREFERRED_MARKET", "REVIEW_LOCATION_EUROPE", "REVIEW_RELOCATION_POSSIBLE")
ATS_HOSTS = ("job-boards.greenhouse.io", "boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "apply.workable.com", "jobs.workable.com", "jobs.smartrecruiters.com", "careers.smartrecruiters.com")

# Statements on location, sentence by sentence.
FALSE_REMOTE = r"\b(?:remote monitoring|remote control|remote access|serve remote teams?|customers? worldwide|worldwide customers?|european customers?|distributed customers?|global (?:company|platform)|international team)\b"
NOT_THIS_ROLE = r"\b(?:for certain roles|for some roles|eligible roles)\b"
REMOTE_TEAM = r"\b(?:distributed,?\s+)?remote-first team\b"
HYBRID_WORK = r"\b(?:hybrid(?: working| work| role| position| culture)?|hybride|mode hybride)\b|\b\d+\s+(?:days?|jours?)\s+(?:a|per|par)\s+(?:week|semaine)\s+(?:in (?:the )?office|sur site)\b"
REMOTE_WORK = r"\b(?:fully remote|remote-first|remote (?:role|position|job|working|environment)|(?:role|position|job|work|working)\s+(?:is\s+)?remote|work remotely|work from anywhere|remote\s+(?:worldwide|within|across|throughout|in|uk)|t[ée]l[ée]travail|travail [àa] distance)\b"
BARE_REMOTE = r"^(?:location|work model|workplace)?\s*:?\s*remote$"
ONSITE_WORK = r"\b(?:onsite|on-site|office-based|must work from (?:our|the) office|on-site technical resource|pr[ée]sentiel)\b|\b(?:travail|poste) sur site\b"
RESIDENCY = r"\b(?:must be based in|need to reside in|must (?:live|reside) in|only candidates? (?:located|based) in|candidates? must (?:live|reside) in|(?:candidat(?:e)?s? |vous |tu )?(?:bas[ée]s?|r[ée]sider|domicili[ée]s?) en)\b"
WORK_PERMIT = r"\b(?:must be authori[sz]ed to work in|must have (?:the )?right to work in|work authori[sz]ation (?:in .+ )?required|(?:eu|eea) work authori[sz]ation required|autoris[ée]s? [àa] travailler en|droit de travailler en|autorisation de travail)\b"
VISA_NO = r"\b(?:do not|don't|cannot|can't|unable to|no) (?:provide )?(?:visa )?sponsor(?:ship|ing)?\b|\b(?:visa sponsorship (?:is )?not available|pas de sponsoring visa|pas de parrainage de visa)\b"
VISA_YES = r"\b(?:visa sponsorship (?:is )?available|we can sponsor (?:eligible )?candidates?|sponsoring (?:a )?visa|sponsoring visa|parrainage de visa|prise en charge du visa)\b"
MOVE_NO = r"\b(?:no|without) relocation (?:support|assistance|package)\b"
MOVE_YES = r"\b(?:relocation (?:assistance|support) (?:is )?available|relocation package (?:is )?provided)\b"
SCOPES = {
    "WORLDWIDE": r"\b(?:worldwide|work from anywhere|anywhere in the world)\b",
    "EEA": r"\b(?:within|across|throughout) (?:the )?EEA\b",
    "EU": r"\b(?:within|across|throughout) (?:the )?(?:EU|European Union)\b",
    "EUROPE": r"\b(?:within|across|throughout) Europe\b|\bpartout en Europe\b",
}
JURISDICTIONS = {"EEA": r"\bEEA\b", "EU": r"\b(?:EU|European Union)\b", "EUROPE": r"\bEurope\b"}

# Where a repaired field came from, by the prefix or name of its source.
REPAIR_METHODS = (
    ("SOURCE_CLASSIFICATION", "SOURCE_CLASSIFICATION"), ("provider_*", "PROVIDER_STRUCTURED"), ("jsonld_*", "JSON_LD"), ("JSON_LD", "JSON_LD"), ("microdata_*", "MICRODATA"),
    ("MICRODATA", "MICRODATA"), ("job_*", "JOB_META"), ("direct_domain_company", "DIRECT_DOMAIN"), ("validated_hosted_tenant_title", "HOSTED_TENANT_TITLE"),
    ("html_job_heading", "HTML_LABEL"), ("PAGE_CONTENT", "HTML_LABEL"), ("title_structured_location", "TITLE_INFERENCE"), ("deterministic_geography", "TITLE_INFERENCE"),
    ("TITLE_PATTERN", "TITLE_INFERENCE"), ("url_structured_location", "URL_INFERENCE"), ("url_structured_title", "URL_INFERENCE"), ("URL_PATTERN", "URL_INFERENCE"),
)
