"""Fixed values of the chat rules (keyword lists, labels, texts).

Kept together and in their natural order; every rule that uses them is a
built-in ``when``/``contains``/``rlike`` chain evaluated inside the JVM.
"""

# Prompt type: first matching rule on the lower-cased question.
PROMPT_TYPE_RULES = [
    ("machineLearning", ["model", "train", "predict", "ml", "machine learning", "algorithm"]),
    ("visualization", ["visualiz", "plot", "chart", "graph", "see ", "show "]),
    ("dataCleaning", ["clean", "missing", "null", "na", "preprocess", "prepare data"]),
]
PROMPT_TYPE_DEFAULT = "dataAnalysis"

# Dataset domain from the joined, lower-cased column names (first match).
DOMAIN_RULES = [
    ("financial", ["price", "sales", "revenue", "profit"]),
    ("healthcare", ["patient", "medical", "health", "diagnosis"]),
    ("ecommerce", ["customer", "order", "product", "purchase"]),
    ("education", ["student", "grade", "course", "education"]),
]
DOMAIN_DEFAULT = "general"

# Insight hints (independent flags) and their texts.
FINANCIAL_HINT_WORDS = ["price", "sales", "revenue", "profit"]
HEALTHCARE_HINT_WORDS = ["patient", "medical", "health", "disease"]
FINANCIAL_HINT = "Financial dataset detected - consider time series and volatility analysis"
HEALTHCARE_HINT = "Healthcare dataset detected - check sensitive fields and PHI"

# Focus: domain keywords first (in order), then the general rules.
FOCUS_DOMAIN_RULES = {
    "financial": [("clean", "financial_data_cleaning"), ("model", "financial_modeling"),
                  ("trend", "financial_trends"), ("forecast", "financial_forecasting"),
                  ("risk", "risk_analysis")],
    "healthcare": [("clean", "healthcare_data_cleaning"), ("model", "healthcare_prediction"),
                   ("patient", "patient_analysis"), ("treatment", "treatment_analysis"),
                   ("risk", "risk_factors")],
    "ecommerce": [("clean", "ecommerce_data_cleaning"), ("model", "ecommerce_prediction"),
                  ("customer", "customer_analysis"), ("sales", "sales_analysis"),
                  ("conversion", "conversion_optimization")],
}
FOCUS_GENERAL_RULES = [
    ("data_cleaning", ["clean", "missing", "null"]),
    ("machine_learning", ["model", "train", "predict"]),
    ("visualization", ["visualiz", "plot", "chart"]),
    ("pattern_analysis", ["pattern", "trend", "insight"]),
    ("code_generation", ["python", "code", "script"]),
]
FOCUS_DEFAULT = "general_analysis"

# Completed-analysis tags found in assistant messages (keyword, tag).
ANALYSIS_TAGS = [("missing", "missing_values"), ("outlier", "outlier_detection"),
                 ("correlation", "correlation_analysis"), ("model", "ml_suggestions"),
                 ("visualiz", "visualization"), ("clean", "data_cleaning")]

# Suggested next steps: five per domain, then gap suggestions, then advanced.
DOMAIN_NEXT_STEPS = {
    "financial": ["Calculate ROI and profitability metrics", "Analyze customer lifetime value",
                  "Perform market basket analysis", "Optimize pricing strategy",
                  "Detect fraudulent transactions"],
    "healthcare": ["Analyze treatment effectiveness", "Calculate readmission rates",
                   "Identify comorbidities", "Optimize resource allocation",
                   "Ensure HIPAA compliance"],
    "ecommerce": ["Analyze shopping cart abandonment", "Calculate customer acquisition cost",
                  "Optimize product recommendations", "Perform A/B testing analysis",
                  "Improve customer retention"],
    "general": ["Explore additional data patterns", "Consider feature engineering",
                "Validate data quality metrics", "Create interactive dashboards",
                "Document findings and insights"],
}
GAP_NEXT_STEPS = [("missing_values", "Analyze and handle missing values"),
                  ("outlier_detection", "Check for outliers and anomalies"),
                  ("correlation_analysis", "Examine correlations between variables"),
                  ("ml_suggestions", "Get machine learning model recommendations")]
ADVANCED_NEXT_STEPS = ["Build complete data preprocessing pipeline",
                       "Create interactive dashboard visualizations",
                       "Develop predictive modeling approach"]
MAX_NEXT_STEPS = 6

# First-session suggestions by domain.
FIRST_SESSION_STEPS = {
    "financial": ["Analyze sales trends over time", "Calculate financial ratios and metrics",
                  "Identify seasonal patterns", "Perform cohort analysis",
                  "Forecast future performance"],
    "healthcare": ["Analyze patient demographics", "Calculate prevalence rates",
                   "Identify risk factors", "Perform survival analysis",
                   "Check data quality for clinical use"],
    "ecommerce": ["Analyze customer behavior", "Calculate conversion rates",
                  "Identify popular products", "Perform RFM analysis",
                  "Optimize marketing campaigns"],
    "education": ["Analyze student performance", "Identify learning patterns",
                  "Calculate success rates", "Perform demographic analysis",
                  "Optimize curriculum design"],
    "general": ["Perform missing value analysis", "Check correlation between features",
                "Explore categorical distributions", "Identify potential outliers",
                "Suggest appropriate ML models"],
}

# Rule-based answer (no model available).
RULE_CLEAN_WORDS = ["clean", "missing", "null"]
RULE_MODEL_WORDS = ["model", "train", "predict", "ml"]
RULE_CLEAN_TEXT = ("🧹 **Data Cleaning Recommendations**\n\nFor your {domain} dataset with "
                   "{missing} missing values:\n\n**Immediate Actions:**\n1. Use Deep Clean feature\n"
                   "2. Numerical: Impute with median/mean\n3. Categorical: Use mode or \"Unknown\"\n"
                   "4. Remove columns >50% missing\n\n{advice}")
RULE_DOMAIN_ADVICE = {
    "financial": "For financial data, consider conservative imputation methods like forward fill.",
    "healthcare": "For healthcare data, consult domain experts before imputing missing values.",
}
RULE_MODELS_MANY = ["Linear Regression", "Random Forest", "XGBoost"]
RULE_MODELS_FEW = ["Random Forest", "CatBoost"]
RULE_MODEL_TEXT = ("🤖 **ML Model Recommendations**\n\n• {models}\n\n**Next Steps:**\n"
                   "1. Preprocess data\n2. Feature engineering\n3. Train-validation split\n"
                   "4. Model evaluation")
RULE_HELP_TEXT = ("💡 I can help with:\n• Data cleaning\n• ML models\n• Python code\n"
                  "• Visualizations\n• Statistical analysis")

# Structured response labels (regexes, case-insensitive, dot matches newline).
RE_EXPLANATION = r"(?isU)EXPLANATION:\s*(.*?)(?=CODE:|NEXT_STEPS:|CHART_TYPE:|DOMAIN_INSIGHTS:|$)"
RE_CODE = r"(?isU)CODE:\s*```python\n(.*?)\n```"
RE_NEXT_STEPS = r"(?isU)NEXT_STEPS:\s*(.*?)(?=CHART_TYPE:|DOMAIN_INSIGHTS:|$)"
RE_CHART_TYPE = r"(?iU)CHART_TYPE:\s*(\w+)"
RE_DOMAIN_INSIGHTS = r"(?isU)DOMAIN_INSIGHTS:\s*(.*?)$"
PROACTIVE_TEXT = "Found {n} missing values. Would you like automatic handling or a preview?"

# Code screening: allowed import roots and blocked patterns (lower-cased text).
SAFE_MODULES = ["math", "random", "datetime", "collections", "itertools", "functools",
                "operator", "re", "json", "numbers", "statistics", "pandas", "numpy"]
BLOCKED_PATTERNS = [r"__.*__", r"os\.", r"sys\.", r"subprocess\.", r"importlib\.", r"open\(",
                    r"eval\(", r"exec\(", r"compile\(", r"pickle\.", r"input\("]

# Auto-run: any unsafe pattern vetoes, then any safe pattern allows.
AUTO_RUN_SAFE = [r"\.head\(", r"\.describe\(", r"\.info\(", r"\.isna\(", r"\.notna\(",
                 r"\.value_counts\(", r"\.corr\(", r"\.shape", r"\.dtypes", r"plt\.", r"sns\."]
AUTO_RUN_UNSAFE = [r"\.to_csv\(", r"\.to_excel\(", r"\.write\(", r"exec\(", r"eval\(", r"open\(",
                   r"system\(", r"subprocess", r"os\.", r"shutil"]

# Session limits.
MAX_SESSIONS = 100
EVICT_COUNT = 10
BACKEND_SESSION_TTL_S = 3600
IDLE_TIMEOUT_S = 2 * 3600
ACTIVE_WINDOW_S = 30 * 60
MAX_MESSAGES = 50
CONTEXT_MESSAGES = 5
HISTORY_MESSAGES = 3

# Analysis prompt sent with each user question (placeholders in braces).
PROMPT_TEMPLATE = """**You are an expert Data Scientist AI** analyzing this dataset:

DATASET:
- FILENAME: {filename}
- SHAPE: {rows} rows × {columns} columns
- COLUMNS: {column_list}
- NUMERICAL: {numerical}
- CATEGORICAL: {categorical}
- MISSING VALUES: {missing}

CHAT_HISTORY:
{history}

USER QUESTION:
{query}

RESPONSE REQUIREMENTS:
1) Provide SPECIFIC advice for THIS dataset
2) Include example Python/pandas CODE when appropriate in a ```python``` block
3) Suggest 2-3 NEXT_STEPS
4) If recommending visualization, include CHART_TYPE
5) Use the structured format: EXPLANATION, CODE, NEXT_STEPS, CHART_TYPE, DOMAIN_INSIGHTS
"""
