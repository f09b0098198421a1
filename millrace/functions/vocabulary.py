"""Fixed values of the posting domain: word lists, patterns and factors, stated as they must match."""

#: Skills by cluster, both in display order.
CLUSTERS: list[tuple[str, str, list[str]]] = [
    ("llm", "LLM & frameworks", ["OpenAI API", "Anthropic API", "LangChain", "LlamaIndex", "DSPy", "vLLM", "Hugging Face"]),
    ("rag", "Retrieval / RAG", ["RAG", "Pinecone", "Weaviate", "pgvector", "Qdrant", "Milvus", "Embeddings", "Reranking"]),
    ("agents", "Agents", ["Tool use", "Multi-agent", "Orchestration", "MCP"]),
    ("evals", "Evals & quality", ["Eval harnesses", "LLM-as-judge", "LangSmith", "Arize", "Observability"]),
    ("inference", "Inference / serving", ["GPU", "Triton", "TensorRT", "Quantization", "Latency", "Throughput"]),
    ("finetuning", "Fine-tuning", ["LoRA", "PEFT", "RLHF", "DPO", "Distillation"]),
    ("core_ml", "Core ML", ["PyTorch", "TensorFlow", "Deep learning", "NLP", "Computer vision"]),
    ("mlops", "MLOps / infra", ["Kubernetes", "Docker", "Ray", "Kubeflow", "SageMaker", "Vertex AI", "Azure ML", "CI/CD"]),
    ("cloud", "Cloud", ["AWS", "Azure", "GCP"]),
    ("language", "Languages", ["Python", "TypeScript", "JavaScript", "Go", "Rust", "C++"]),
]

#: Titles in scope.
IN_TITLES = [
    r"\bai engineer\b", r"\bgen.?ai\b", r"\bgenerative ai\b", r"\bllm\b", r"\brag\b", r"\bagent(s|ic)?\b", r"\binference\b", r"\bapplied ai\b",
    r"\bforward.?deployed\b", r"\bfine.?tun", r"\beval(s|uation)?\b", r"\bmodel serving\b", r"\bresearch engineer\b", r"\bresearch scientist\b",
    r"\bmember of technical staff\b", r"\bdeploy(ed|ment) engineer", r"\bpost.?training\b", r"\b(reinforcement learning|rlhf|dpo)\b",
]

#: Titles out of scope, whatever else they match.
OUT_TITLES = [
    r"\bdata analyst\b", r"\bbusiness intelligence\b", r"\bsales\b", r"\bmarketing\b", r"\brecruiter\b", r"\bdesigner\b", r"\baccount executive\b",
    r"\bproduct manager\b", r"\boutcomes manager\b",
]

#: Titles worth a detail fetch on large boards.
TECH_TITLE = (
    r"\b(engineer|engineering|developer|software|swe|machine learning|\bml\b|\bai\b|data|scien|research|quant|analytics|platform|infrastructure|"
    r"architect|llm|nlp|intelligence|model|mlops|devops|sre)\b"
)
BOARD_QUERIES = ["machine learning", "generative ai", "llm"]

IN_CONFIDENCE, OUT_CONFIDENCE, DEFAULT_CONFIDENCE, VETO_CONFIDENCE, SCORER_CONFIDENCE = 0.85, 0.9, 0.3, 0.7, 0.6

#: Seniority by title, first match wins.
SENIORITY = [
    ("intern", r"\bintern(ship)?\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("manager", r"\b(head of|director|vp|vice president|manager)\b"),
    ("lead", r"\blead\b"),
    ("senior", r"\b(senior|sr\.?)\b"),
    ("junior", r"\b(junior|jr\.?|associate|new ?grad|entry[- ]level|graduate)\b"),
]
SENIORITY_ORDER = ["intern", "junior", "mid", "senior", "staff", "principal", "lead", "manager"]

#: Countries by location text, first match wins; then US state codes, case-sensitive.
COUNTRIES = [
    ("US", r"\b(united states|u\.?s\.?a?\.?|usa)\b"),
    ("GB", r"\b(united kingdom|u\.?k\.?|england|scotland|wales|london)\b"),
    ("CA", r"\b(canada|toronto|vancouver|montreal)\b"),
    ("DE", r"\b(germany|berlin|munich|münchen)\b"),
    ("FR", r"\b(france|paris)\b"),
    ("NL", r"\b(netherlands|amsterdam)\b"),
    ("IE", r"\b(ireland|dublin)\b"),
    ("IN", r"\b(india|bangalore|bengaluru|mumbai)\b"),
    ("SG", r"\b(singapore)\b"),
    ("AU", r"\b(australia|sydney|melbourne)\b"),
]
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()

#: Role families by title, first match wins.
ROLES = [
    ("Data Scientist", r"data scien"),
    ("Data Engineer", r"data engineer|analytics engineer"),
    ("Research", r"research scien|research engineer|\bresearcher\b|applied scientist|\bscientist\b|member of (technical staff|engineering)|pre.?training|post.?training"),
    ("ML Engineer", r"machine learning|\bml\b|mlops|deep learning|\bnlp\b"),
    ("AI Engineer", r"\bai engineer|applied ai|forward deployed|solutions? engineer|solutions? architect|ai architect|deployed engineer|genai|generative ai|\bagent|\bllm|\bgpt\b|prompt"),
    ("Software Engineer", r"software engineer|\bswe\b|backend|frontend|full.?stack|infrastructure|platform engineer|\bsre\b|site reliability|devops|production engineer"),
    ("Management", r"\bmanager\b|\blead\b|head of|\bdirector\b|\bvp\b|strateg"),
]

#: US dollars per unit: for ranking, and the fallback of the live feed.
RANK_FX = {"USD": 1.0, "GBP": 1.27, "EUR": 1.08, "CAD": 0.73, "AUD": 0.66, "SGD": 0.74, "INR": 0.012}
FEED_FX = RANK_FX | {"CHF": 1.12, "SEK": 0.095}
PERIODS = {"year": 1, "month": 12, "day": 260, "hour": 2080}
PAY_FLOOR, PAY_CEILING = 10_000, 2_000_000

REMOTE_LABELS = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "On-site"}
SENIORITY_LABELS = {s: s.capitalize() for s in SENIORITY_ORDER}
