# -*- coding: utf-8 -*-
"""Fixed values.

These lists and tables must equal the reference's for equal results: column-role
names, synonyms, rule tables and their texts. They are stated once, here, in
their natural order. Everything else in the library derives from them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: column roles by name
# ---------------------------------------------------------------------------

REQUIRED_COLUMNS = ["client_id", "activity_date", "churned"]
RFM_RECOMMENDED = ["transaction_count", "total_orders", "total_revenue", "monthly_fee", "monthly_charges"]
VALUE_COLUMNS = ["total_revenue", "monthly_fee", "monthly_charges", "total_charges"]
FREQUENCY_HINT_COLUMNS = ["transaction_count", "total_orders", "calls_to_support"]

COLUMN_SYNONYMS = {
    "customer_id": "client_id",
    "user_id": "client_id",
    "last_activity": "activity_date",
    "last_login": "activity_date",
    "last_order_date": "activity_date",
    "is_churned": "churned",
    "churn": "churned",
    "attrited": "churned",
    "revenue": "total_revenue",
    "spent": "total_revenue",
    "amount": "total_revenue",
    "orders": "total_orders",
    "transactions": "transaction_count",
    "tenure": "tenure_months",
}

RECENCY_CANDIDATES = ["days_since_last_login", "days_since_last_order", "days_since_last_activity", "recency_days"]
FREQUENCY_CANDIDATES = ["total_orders", "transaction_count", "calls_to_support", "feature_adoption_count",
                        "total_orders", "product_categories_used"]
MONETARY_CANDIDATES = ["total_revenue", "monthly_fee", "monthly_charges", "total_charges", "avg_order_value"]
RECENCY_HINTS = ["days_since"]
FREQUENCY_HINTS = ["count", "orders", "total"]
MONETARY_HINTS = ["revenue", "fee", "charges", "spent"]

# LTV source columns for recommendations, first present wins; default when none.
LTV_COLUMNS = ["total_revenue", "monthly_fee", "monthly_charges", "total_charges"]
LTV_DEFAULT = 100.0

ID_PATTERNS = ["client_id", "customer_id", "user_id", "id"]

CSV_ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "cp1251"]
CSV_DELIMITERS = [",", ";", "\t", "|"]

# ---------------------------------------------------------------------------
# FIXED VALUES: RFM segments
# ---------------------------------------------------------------------------

SEGMENT_ORDER = ["Champions", "Loyal", "At Risk", "Hibernating", "Lost"]

# (priority, action, channel, tone, urgency, offer, retention_lift_pct)
SEGMENT_ACTIONS = {
    "Champions": ("low",
                  "Программа лояльности. Попросить рефералов и кейс-стади.",
                  "email", "благодарность", "none",
                  "Ранний доступ к новым фичам", 0.95),
    "Loyal": ("medium",
              "Upsell до Premium. Показать неиспользуемые фичи. Пригласить на вебинар.",
              "in-app + email", "вовлечение", "low",
              "Бесплатный месяц Premium при переходе на годовой план", 0.85),
    "At Risk": ("critical",
                "Персональный звонок менеджера. Спецпредложение. Решить все открытые тикеты.",
                "phone + email", "срочность", "critical",
                "Промокод 20% с expiry 7 дней. Персональный план удержания.", 0.50),
    "Hibernating": ("high",
                    "Реактивационная email-цепочка «Мы скучаем». Опрос NPS. Показ новых фичей.",
                    "email", "теплота", "medium",
                    "Бесплатный аудит использования. Скидка 15% на возвращение.", 0.30),
    "Lost": ("low",
             "Win-back кампания. Глубокий дисконт или не тратить бюджет.",
             "email", "последний шанс", "low",
             "Скидка 30% на первые 3 месяца при возвращении", 0.10),
}

URGENT_PREFIX = "🔥 СРОЧНО: "
WARNING_PREFIX = "⚠ "
URGENT_CHANNEL = "phone + sms + email"
ESCALATED_SEGMENTS = ["At Risk", "Hibernating"]
MEDIUM_RISK_FLOOR = 0.4
HIGH_RISK_LIFT_FACTOR = 0.7
LOW_RISK_LIFT_FACTOR = 1.1

# Feature-name key -> advice text; the first key contained in a factor wins.
FACTOR_ADVICE = [
    ("days_since_last_login", "📅 Клиент давно не заходил — отправить персонализированное push-уведомление с новым контентом."),
    ("days_since_last_order", "🛒 Давно не было заказов — предложить персональную подборку на основе истории."),
    ("support_tickets_last_30d", "🎫 Много открытых тикетов — эскалировать в support, решить до звонка по удержанию."),
    ("calls_to_support", "📞 Частые звонки в поддержку — провести аудит качества обслуживания."),
    ("subscription_tier_basic", "💳 Базовый тариф — предложить апгрейд со скидкой за лояльность."),
    ("contract_type_month-to-month", "📄 Помесячный контракт — предложить годовой со скидкой 15%."),
    ("login_frequency_decline", "📉 Снижение частоты логинов — триггер реактивационной кампании."),
    ("nps_score", "📊 Низкий NPS — провести глубинное интервью, понять причины недовольства."),
    ("has_technical_issues", "🔧 Технические проблемы — направить в техническую поддержку с высоким приоритетом."),
    ("competitor_offer_seen", "🏢 Видел предложение конкурента — подготовить встречное предложение с match-скидкой."),
    ("payment_delay_count", "💸 Задержки платежей — проверить платёжный метод, предложить рассрочку."),
    ("return_rate", "↩️ Высокий процент возвратов — проанализировать причины, возможно проблема в товаре."),
    ("email_open_rate", "📧 Не открывает письма — сменить канал на SMS/push/звонок."),
    ("has_app_installed", "📱 Нет приложения — предложить установку с бонусом за первый заказ."),
    ("has_dedicated_manager", "👤 Нет персонального менеджера — назначить для Enterprise-клиентов."),
    ("avg_session_duration_min", "⏱️ Короткие сессии — упростить onboarding, добавить гайды."),
    ("feature_adoption_count", "🔧 Мало используемых фичей — провести training, показать value."),
    ("international_plan", "🌍 Международный план — проверить качество связи в роуминге."),
    ("data_usage_gb", "📶 Низкое потребление данных — возможно, клиент использует конкурента для данных."),
    ("discount_usage_pct", "🏷️ Высокая доля скидочных заказов — клиент чувствителен к цене, не повышать."),
    ("reviews_written", "✍️ Не пишет отзывы — попросить отзыв за бонусные баллы."),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: thresholds
# ---------------------------------------------------------------------------

MISSING_CRITICAL_PCT = 20
MISSING_SIGNIFICANT_PCT = 5
OUTLIERS_MANY_PCT = 10
OUTLIERS_MODERATE_PCT = 3
IQR_FACTOR = 1.5
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99
HIGH_MISSING_COLUMN_PCT = 30
SCORE_CRITICAL, SCORE_MEDIUM = 40, 70
MAX_ONEHOT_CATEGORIES = 15
RATIO_CLIP_Q = 0.99
PSI_BINS, PSI_EPS = 10, 1e-6
PSI_THRESHOLD, PSI_SEVERE = 0.15, 0.25
KS_ALPHA = 0.05
MODEL_NAMES = ["Logistic Regression", "Random Forest", "XGBoost"]

# ---------------------------------------------------------------------------
# FIXED VALUES: report message formats ({:.0f} / {:.1f} style numbers)
# ---------------------------------------------------------------------------

MSG_MISSING_CRITICAL = "Критические пропуски: {pct0}%"
MSG_MISSING_SIGNIFICANT = "Значительные пропуски: {pct1}%"
MSG_CONSTANT = "Все значения одинаковы — колонка бесполезна"
MSG_OUTLIERS_MANY = "Много выбросов: {pct0}% значений за пределами IQR"
MSG_OUTLIERS_MODERATE = "Умеренные выбросы: {pct1}%"
MSG_DUPLICATES = "Найдено {n} дубликатов строк ({pct1}%)"
MSG_QUALITY_CRITICAL = "Критическое качество данных — требуется глубокая очистка"
MSG_QUALITY_MEDIUM = "Среднее качество данных — рекомендуется очистка перед ML"
MSG_HIGH_MISSING_COLUMNS = "Колонки с >30% пропусков: {names}"
FILL_UNKNOWN = "UNKNOWN"

# ---------------------------------------------------------------------------
# FIXED VALUES: drift alert texts
# ---------------------------------------------------------------------------

MSG_DRIFT_NONE = "✅ Дрифт данных не обнаружен. Модель стабильна."
MSG_DRIFT_SEVERE = "🔴 Критический дрифт в признаках: **{names}**. Рекомендуется переобучить модель."
MSG_DRIFT_MODERATE = ("🟡 Умеренный дрифт в признаках: **{names}**. "
                      "Рекомендуется мониторинг и проверка качества прогнозов.")
# ours: a line for drift found by the KS test alone (the reference prints none)
MSG_DRIFT_KS_ONLY = "🟠 Статистический дрифт (KS-тест) в признаках: **{names}**."

# ---------------------------------------------------------------------------
# FIXED VALUES: explanation texts
# ---------------------------------------------------------------------------

DIRECTION_RISK = "повышает риск"
DIRECTION_PROTECTIVE = "снижает риск"
MSG_TOP_RISK = "Основной фактор риска: **{feature}** ({value3}). Вероятность оттока: **{pct1}**."
MSG_NO_RISK = "Значимых факторов риска не выявлено. Вероятность оттока: **{pct1}**."
FALLBACK_BASE_VALUE = 0.5

# ---------------------------------------------------------------------------
# FIXED VALUES: executive summary template ({n:,} {pct1%} {money:,.0f} {auc2})
# ---------------------------------------------------------------------------

EXECUTIVE_SUMMARY = """## 📊 Executive Summary: Анализ оттока клиентов

### Текущая ситуация
- **Всего клиентов:** {total_clients}
- **Уровень оттока:** {churn_rate}
- **Деньги под угрозой:** ${money_at_risk}
- **Качество модели:** AUC-ROC = {auc}

### Ключевые сегменты
- 🔥 **At Risk:** {at_risk} клиентов — были ценными, но теряют активность. **Приоритет #1.**
- 💤 **Hibernating:** {hibernating} клиентов — низкая активность, требуют реактивации.

### Главный фактор оттока
**{top_factor}** — основной драйвер оттока. Рекомендуется сфокусировать retention-усилия на этом направлении.

### Рекомендуемые действия
1. **Сегодня:** обзвонить топ-20 At Risk клиентов с наибольшим LTV
2. **На этой неделе:** запустить реактивационную кампанию для Hibernating
3. **В этом месяце:** внедрить предиктивный мониторинг на основе модели (AUC {auc})

---
*Отчёт сгенерирован автоматически. Для деталей обратитесь к дашборду.*
"""

# report lines
REPORT_TOTAL = "Total Clients: {n}"
REPORT_CHURN = "Churn Rate: {pct1}"
REPORT_BEST = "Best Model: {name} (AUC-ROC: {auc3})"
REPORT_SEGMENT = "  {seg}: {n} clients ({pct1})"
REPORT_TOP = "  {i}. {cid} | {seg} | Churn: {pct1}"
EXPORT_COLUMNS = ["client_id", "rfm_segment", "churn_prob", "churn_risk_level", "ltv", "action",
                  "channel", "offer", "urgency", "roi_estimate"]
