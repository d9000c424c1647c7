"""Rules of the extractors, as data.

All of them are fixed values: patterns, labels and their order decide the results.
"""

# Requirements of spoken languages.
LANGUAGE = (
    (r"\b(fluent|native|proficient|excellent)\s+(in\s+)?dutch\b", "Dutch required"),
    (r"\bdutch\s+(is\s+)?(required|mandatory|essential|necessary|must)\b", "Dutch required"),
    (r"\b(must|need to|should)\s+(speak|know|have)\s+dutch\b", "Dutch required"),
    (r"\bnederlands\s+(is\s+)?(vereist|verplicht)\b", "Dutch required"),
    (r"\bdutch\s+(is\s+)?(preferred|nice|advantage|plus|bonus)\b", "Dutch preferred"),
    (r"\b(preferably|ideally)\s+(speak|know)\s+dutch\b", "Dutch preferred"),
    (r"\b(fluent|native|proficient|excellent)\s+(in\s+)?english\b", "English fluent"),
    (r"\benglish\s+(is\s+)?(required|mandatory|essential|necessary|must)\b", "English required"),
    (r"\b(professional|business|working)\s+(level\s+)?english\b", "English professional"),
    (r"\b(fluent|native|proficient|excellent)\s+(in\s+)?german\b", "German fluent"),
    (r"\bgerman\s+(is\s+)?(required|mandatory|essential|preferred)\b", "German required"),
    (r"\b(fluent|native|proficient|excellent)\s+(in\s+)?french\b", "French fluent"),
    (r"\bfrench\s+(is\s+)?(required|mandatory|essential|preferred)\b", "French required"),
    (r"\b(multilingual|polyglot|multiple languages)\b", "Multilingual"),
    (r"\b(bilingual)\b", "Bilingual"),
)

# Where work is done.
REMOTE_POLICY = (
    (r"\b(fully|100%|completely)\s+remote\b", "remote"),
    (r"\bremote[- ]first\b", "remote"),
    (r"\bwork\s+(from\s+)?(home|anywhere)\b", "remote"),
    (r"\bremote\s+(position|role|job|work|opportunity)\b", "remote"),
    (r"\bhybrid\s+(work|model|role|position|environment|setup|arrangement)\b", "hybrid"),
    (r"\b(hybrid)\b(?!\s+cloud)", "hybrid"),
    (r"\b(\d+)\s*days?\s*(in\s+)?(the\s+)?office\b", "hybrid"),
    (r"\bcombination\s+of\s+(remote|office|home)\b", "hybrid"),
    (r"\b(remote|home)\s+and\s+(office|on[- ]?site)\b", "hybrid"),
    (r"\b(on[- ]?site|in[- ]?office|office[- ]based)\b", "onsite"),
    (r"\b(fully|100%)\s+(on[- ]?site|in[- ]?office)\b", "onsite"),
    (r"\bpresence\s+(in|at)\s+(the\s+)?office\b", "onsite"),
)
REMOTE_ORDER = ("remote", "hybrid", "onsite")

# Years of experience, and seniority.
YEARS = (
    r"\b(\d+)\s*\+?\s*years?\s*(of\s+)?(professional\s+|relevant\s+|work\s+)?experience\b",
    r"\b(\d+)\s*-\s*(\d+)\s*years?\s*(of\s+)?(professional\s+|relevant\s+|work\s+)?experience\b",
    r"\bminimum\s+(\d+)\s*years?\b",
    r"\bat\s+least\s+(\d+)\s*years?\b",
    r"\b(\d+)\s*\+?\s*years?\s+(in|with|working)\b",
)
SENIORITY = (
    (r"\b(junior|entry[- ]level|graduate|starter|trainee)\b", "junior"),
    (r"\b(mid[- ]?level|intermediate|medior)\b", "mid"),
    (r"\b(senior|sr\.?|experienced|advanced)\b", "senior"),
    (r"\b(lead|team\s+lead|tech\s+lead|principal)\b", "lead"),
    (r"\b(staff|distinguished|fellow)\b", "staff"),
    (r"\b(head\s+of|director|vp|vice\s+president|chief)\b", "executive"),
    (r"\b(manager|managing)\b", "manager"),
)

# Levels of education, fields, and how firmly they are asked for.
EDUCATION = (
    (r"\b(ph\.?d|doctorate|doctoral)\b", "PhD"),
    (r"\b(master'?s?\s+degree|m\.?sc\.?|m\.?a\.?|m\.?eng\.?|m\.?b\.?a\.?|mba)\b", "Master"),
    (r"\bmaster'?s?\s+(in|of)\b", "Master"),
    (r"\b(bachelor'?s?\s+degree|b\.?sc\.?|b\.?a\.?|b\.?eng\.?|b\.?b\.?a\.?)\b", "Bachelor"),
    (r"\bbachelor'?s?\s+(in|of)\b", "Bachelor"),
    (r"\b(university|college)\s+degree\b", "Degree"),
    (r"\b(higher\s+education|post[- ]?graduate|postgraduate)\b", "Postgraduate"),
    (r"\b(diploma|associate'?s?\s+degree|certification)\b", "Diploma/Certificate"),
)
FIELD = r"\b(computer\s+science|software\s+engineering|information\s+technology|data\s+science|statistics|mathematics|physics|engineering|business\s+administration|economics|artificial\s+intelligence|machine\s+learning|information\s+systems|quantitative\s+field|stem|technical\s+field|related\s+field)\b"
PREFERRED = r"\b(preferred|nice[- ]to[- ]have|advantage|bonus|plus|or\s+equivalent)\b"
REQUIRED = r"\b(required|mandatory|must|essential|necessary)\b"

# Benefits.
BENEFITS = (
    (r"\b(competitive\s+salary|salary\s+range|base\s+salary|annual\s+salary)\b", "salary"),
    (r"\b(equity|stock\s+options|shares|esop|rsu|vesting)\b", "equity"),
    (r"\b(bonus|performance\s+bonus|annual\s+bonus|signing\s+bonus)\b", "bonus"),
    (r"\b(profit[- ]?sharing)\b", "profit sharing"),
    (r"\b(\d+)\s*days?\s*(of\s+)?(annual\s+|paid\s+)?(leave|holiday|vacation|pto)\b", "paid leave"),
    (r"\b(unlimited\s+(pto|vacation|leave|time\s+off))\b", "unlimited PTO"),
    (r"\b(paid\s+time\s+off|pto|vacation\s+days?)\b", "paid leave"),
    (r"\b(sabbatical)\b", "sabbatical"),
    (r"\b(health\s+insurance|medical\s+insurance|healthcare)\b", "health insurance"),
    (r"\b(dental|vision)\s+(insurance|coverage|plan)\b", "dental/vision"),
    (r"\b(mental\s+health|wellness\s+program|gym\s+membership|fitness)\b", "wellness"),
    (r"\b(life\s+insurance|disability\s+insurance)\b", "life insurance"),
    (r"\b(pension|401k|401\(k\)|retirement\s+plan|pensioen)\b", "pension"),
    (r"\b(flexible\s+(hours|schedule|working)|flextime|flexibel)\b", "flexible hours"),
    (r"\b(work[- ]life\s+balance|work\s+life\s+balance)\b", "work-life balance"),
    (r"\b(compressed\s+work\s*week|4[- ]day\s+week|32[- ]hour)\b", "compressed week"),
    (r"\b(training\s+budget|learning\s+budget|education\s+budget|development\s+budget)\b", "training budget"),
    (r"\b(professional\s+development|career\s+(development|growth)|l&d)\b", "career development"),
    (r"\b(conference|courses?|certifications?|workshops?)\b", "learning opportunities"),
    (r"\b(laptop|macbook|equipment\s+(budget|allowance))\b", "equipment"),
    (r"\b(home\s+office\s+(budget|allowance|setup))\b", "home office budget"),
    (r"\b(travel\s+allowance|commute|transport\s+allowance|ns[- ]business\s+card|ov[- ]?chipkaart)\b", "transport"),
    (r"\b(lunch|meals?|snacks|free\s+food|catering)\b", "meals"),
    (r"\b(company\s+car|lease\s+car|car\s+allowance)\b", "company car"),
    (r"\b(relocation\s+(support|package|assistance))\b", "relocation"),
    (r"\b(parental\s+leave|maternity|paternity)\b", "parental leave"),
    (r"\b(employee\s+discount|corporate\s+discount)\b", "discounts"),
    (r"\b(team\s+(events?|building|outings?)|company\s+events?|borrels?)\b", "team events"),
)

# Headers of sections, and the names they go by.
SECTION_NAMES = {
    "responsibilities": "responsibilities",
    "what you'll do": "responsibilities",
    "what youll do": "responsibilities",
    "what you will do": "responsibilities",
    "your role": "responsibilities",
    "the role": "responsibilities",
    "key responsibilities": "responsibilities",
    "main responsibilities": "responsibilities",
    "role description": "responsibilities",
    "requirements": "requirements",
    "qualifications": "requirements",
    "what we're looking for": "requirements",
    "what were looking for": "requirements",
    "what you bring": "requirements",
    "must-have": "requirements",
    "must have": "requirements",
    "nice-to-have": "nice_to_have",
    "nice to have": "nice_to_have",
    "preferred": "nice_to_have",
    "desired": "nice_to_have",
    "bonus points": "nice_to_have",
    "about you": "about_you",
    "your profile": "about_you",
    "who you are": "about_you",
    "ideal candidate": "about_you",
    "about us": "about_company",
    "about the company": "about_company",
    "who we are": "about_company",
    "about the team": "about_company",
    "the team": "about_company",
    "benefits": "benefits",
    "perks": "benefits",
    "what we offer": "benefits",
    "compensation": "benefits",
    "our offer": "benefits",
    "culture": "culture",
    "our values": "culture",
    "how we work": "culture",
    "how to apply": "how_to_apply",
    "application process": "how_to_apply",
    "next steps": "how_to_apply",
    "skills": "skills",
    "technical skills": "skills",
    "required skills": "skills",
    "education": "education",
    "educational requirements": "education",
    "experience": "experience",
    "work experience": "experience",
    "professional experience": "experience",
    "tools": "tools",
    "technologies": "tools",
    "tech stack": "tools",
    "stack": "tools",
    "languages": "languages",
    "language requirements": "languages",
}
SMALL_HEADER = r"(?i)^\s*(responsibilities|what you'?ll do|what you will do|requirements|qualifications|must[- ]?have|nice[- ]?to[- ]?have|about you|about us|benefits|compensation|culture|how to apply)\s*:?\s*$"

# What a section's content says about its name, tried in this order.
CONTENT = (
    (r"(python|java|sql|aws|docker|kubernetes|power\s*bi|tableau|qlik|excel|sap|erp|crm|salesforce|jira|confluence|postman|swagger|agile|scrum|git|azure|rest|api|json|xml|html|css|javascript|c#|\.net|dbt|nosql|mongodb|bigquery|hive|exago|erwin|sas\s*eg|kimball|aws\s*glue|bpmn|uml|lean|six\s*sigma|bizbok|bisl|isqi|bcs|one\s*identity|sailpoint|active\s*directory|iam|navision|dynamics\s*nav|murex|mxml|msmq|iis|siebel|sharepoint|visual\s*studio|soap|livebook|eod|gom)", "skills"),
    (r"(you will|you'll|responsible for|your role|your tasks|your mission|the challenge|what you'll do|tricks of the trade|develop|build|create|lead|manage|coordinate|facilitate|support|collaborate|translate|design|implement|maintain|analyze|conduct|engage|deliver|contribute|drive|establish|identify|assess|provide|work closely|act as|own|ensure|spearhead|partner|quantify|monitor|uncover|obtain|scope|supervise|capture|review and edit|be expert in|take the lead)", "responsibilities"),
    (r"(\d+\+?\s*years?|experience|degree|bachelor|master|phd|hbo|wo|qualification|required|must have|essential|mandatory|proven track|expertise in|proficient|knowledge of|familiar with|understanding of|skilled at|fluent in|certification|ireb|babok|itil|togaf|competenc|self-starter|curious mindset|comfortable working in ambiguity|fast-paced|minimal oversight|portfolio|hands-on experience|conceptual understanding|exposure to|capability to manage|perseverance)", "requirements"),
    (r"(nice to have|bonus points|plus|advantage|preferred|desirable|beneficial|ideal|strong plus|is a plus|is advantageous|is a big advantage|is beneficial|knowledge of .* is a plus)", "nice_to_have"),
    (r"(salary|gross monthly|compensation|bonus|vacation|holiday|health|insurance|pension|equity|stock|perks|benefits|working from home|hybrid|remote|wfh|allowance|leave|parental|travel|bike|lease|discount|development|training|academy|13th month|benefit budget|personal development budget|atv days|ns business card|lease car|mobility budget|laptop and phone|shuttle bus|end-of-year bonus|performance bonus)", "benefits"),
    (r"(we are|our company|our team|our mission|our purpose|our values|founded|established|headquartered|about us|organization|who we are|what we do|leading|global|international|employees|turnover|revenue)", "about_company"),
    (r"(about the role|position overview|job profile|the role|the position|the opportunity|introduction|in a nutshell|summary of the role|main purpose|your mission|the challenge|vacancy description|how you fit)", "role_description"),
    (r"(apply now|how to apply|contact us|get in touch|interested|recruitment|application process|want to know more|do you want more information|express your interest|questions about|contact the recruiter|we would like to meet you)", "application_info"),
    (r"(our culture|work environment|team|atmosphere|values|diversity|inclusion|working at|join us|why work|what makes|open no-nonsense|international cooperation|connection|down to earth|collaborative mindset)", "culture_team"),
)

# Other spellings of names; a later entry of the same spelling counts.
ALIASES = (
    ("js", "JavaScript"),
    ("javascript", "JavaScript"),
    ("ts", "TypeScript"),
    ("typescript", "TypeScript"),
    ("py", "Python"),
    ("python", "Python"),
    ("c#", "C#"),
    ("csharp", "C#"),
    ("c++", "C++"),
    ("cpp", "C++"),
    ("golang", "Go"),
    ("go", "Go"),
    ("rb", "Ruby"),
    ("ruby", "Ruby"),
    ("ml", "Machine Learning"),
    ("machine learning", "Machine Learning"),
    ("dl", "Deep Learning"),
    ("deep learning", "Deep Learning"),
    ("nlp", "Natural Language Processing"),
    ("natural language processing", "Natural Language Processing"),
    ("cv", "Computer Vision"),
    ("computer vision", "Computer Vision"),
    ("ai", "Artificial Intelligence"),
    ("artificial intelligence", "Artificial Intelligence"),
    ("llm", "Large Language Models"),
    ("llms", "Large Language Models"),
    ("large language models", "Large Language Models"),
    ("gen ai", "Generative AI"),
    ("genai", "Generative AI"),
    ("generative ai", "Generative AI"),
    ("aws", "AWS"),
    ("amazon web services", "AWS"),
    ("gcp", "GCP"),
    ("google cloud", "GCP"),
    ("google cloud platform", "GCP"),
    ("azure", "Azure"),
    ("microsoft azure", "Azure"),
    ("postgres", "PostgreSQL"),
    ("postgresql", "PostgreSQL"),
    ("mongo", "MongoDB"),
    ("mongodb", "MongoDB"),
    ("mysql", "MySQL"),
    ("ms sql", "SQL Server"),
    ("sql server", "SQL Server"),
    ("mssql", "SQL Server"),
    ("elasticsearch", "Elasticsearch"),
    ("elastic search", "Elasticsearch"),
    ("es", "Elasticsearch"),
    ("redis", "Redis"),
    ("k8s", "Kubernetes"),
    ("kubernetes", "Kubernetes"),
    ("docker", "Docker"),
    ("tf", "Terraform"),
    ("terraform", "Terraform"),
    ("gh actions", "GitHub Actions"),
    ("github actions", "GitHub Actions"),
    ("ci/cd", "CI/CD"),
    ("cicd", "CI/CD"),
    ("react", "React"),
    ("reactjs", "React"),
    ("react.js", "React"),
    ("vue", "Vue.js"),
    ("vuejs", "Vue.js"),
    ("vue.js", "Vue.js"),
    ("angular", "Angular"),
    ("angularjs", "Angular"),
    ("node", "Node.js"),
    ("nodejs", "Node.js"),
    ("node.js", "Node.js"),
    ("next", "Next.js"),
    ("nextjs", "Next.js"),
    ("next.js", "Next.js"),
    ("fastapi", "FastAPI"),
    ("fast api", "FastAPI"),
    ("django", "Django"),
    ("flask", "Flask"),
    ("spring", "Spring Boot"),
    ("spring boot", "Spring Boot"),
    ("springboot", "Spring Boot"),
    ("pbi", "Power BI"),
    ("power bi", "Power BI"),
    ("powerbi", "Power BI"),
    ("tableau", "Tableau"),
    ("looker", "Looker"),
    ("pandas", "Pandas"),
    ("numpy", "NumPy"),
    ("scipy", "SciPy"),
    ("sklearn", "Scikit-learn"),
    ("scikit-learn", "Scikit-learn"),
    ("scikit learn", "Scikit-learn"),
    ("pytorch", "PyTorch"),
    ("torch", "PyTorch"),
    ("tensorflow", "TensorFlow"),
    ("tf", "TensorFlow"),
    ("keras", "Keras"),
    ("hf", "Hugging Face"),
    ("huggingface", "Hugging Face"),
    ("hugging face", "Hugging Face"),
    ("snowflake", "Snowflake"),
    ("databricks", "Databricks"),
    ("bigquery", "BigQuery"),
    ("big query", "BigQuery"),
    ("redshift", "Redshift"),
    ("airflow", "Airflow"),
    ("apache airflow", "Airflow"),
    ("dbt", "dbt"),
    ("spark", "Apache Spark"),
    ("apache spark", "Apache Spark"),
    ("pyspark", "Apache Spark"),
    ("kafka", "Apache Kafka"),
    ("apache kafka", "Apache Kafka"),
)
