"""The rule table of the categoriser.

Fixed values: rule ids, categories, priorities and patterns, in natural order. Rules apply by priority, equal ones
in this order.
"""

RULES = [
    ("USR_DEP_FEE_01", "DEPOSIT", 215, r"ведение\s+вкладного\s+сч[её]та|ндс\s+не\s+облагается.{0,80}вклад|согласно\s+тарифов?.{0,40}вклад"),
    ("USR_DEP_INCOME_01", "DEPOSIT", 214, r"взнос\s+во\s+вклад|плат[её]ж\s+на\s+deposit|плат[её]ж\s+о\s+deposit|досрочное\s+расторжение\s+по\s+вкладу|deposit\s+branch"),
    ("USR_ANY_COMMISSION_01", "INTERNAL", 215, r"комисси[яиюи]|\b(commission|fee)\b"),
    ("USR_INTERNAL_01", "INTERNAL", 214, r"комисси[яи]\s+за\s+перевод\s+в\s+тенге|переводы?\s+клиентом\s+денег\s+со\s+своего\s+текущего\s+сч[её]та.{0,80}на\s+свой\s+текущий\s+сч[её]т|удержание\s+суммы\s+ранее\s+выплаченного\s+вознаграждения|cardfeemonthly"),
    ("USR_INTERNAL_02", "INTERNAL", 213, r"со\s+своего\s+текущего\s+сч[её]та\s+в\s+одном\s+банке\s+на\s+свой\s+текущий\s+сч[её]т\s+в\s+другом\s+банке"),
    ("USR_P2P_01", "P2P", 214, r"перевод\s+с\s+текущего\s+сч[её]та\s+с\s+использованием\s+перевода\s+с\s+текущего\s+сч[её]та\s+на\s+чужой\s+карточный\s+сч[её]т|перевод\s+в\s+ббу"),
    ("USR_CASH_01", "CASH", 214, r"выдано\s+со\s+сч[её]та\s+клиента|снятие\s+с\s+долгосрочного\s+вклада|cash\s+dispense|cash\s+auto\s+kassa|cash\s+tcbo"),
    ("USR_FX_01", "FX", 214, r"за\s+проданные\s+по\s+курсу"),
    ("USR_TOPUP_01", "TOPUP", 214, r"soa_credit\s+popolnenie\s+kartochnogo\s+scheta\s+cherez\s+platezhnyi\s+terminal"),
    ("HALYK_RETAIL_01", "STORE", 205, r"\bretail\b"),
    ("HALYK_CH_PAYMENT_01", "CARD", 204, r"\bch\s*payment\b"),
    ("HALYK_CH_DEBIT_01", "CARD", 204, r"\bch\s*debit\b"),
    ("ALIMONY_01", "ALIMONY", 200, r"алимент"),
    ("LOAN_ISS_01", "LOAN_ISS", 190, r"выдач\w*\s+(займ|кредит|заем|ссуд)"),
    ("LOAN_ISS_02", "LOAN_ISS", 190, r"предоставлен\w*\s+(займ|кредит|ссуд)"),
    ("LOAN_ISS_03", "LOAN_ISS", 185, r"отнесено\s+в\s+займ"),
    ("LOAN_ISS_04", "LOAN_ISS", 188, r"перечислен\w+\s+сумм\w+\s+займ"),
    ("LOAN_ISS_05", "LOAN_ISS", 185, r"микрокредит\w*\s+физическ"),
    ("LOAN_REP_01", "LOAN_REP", 190, r"погашен\w*\s+(кредит|займ|заем|долг|задолженност|ипотек)"),
    ("LOAN_REP_02", "LOAN_REP", 185, r"(возврат|выплат)\w*\s+(кредит|займ|долг)"),
    ("LOAN_REP_03", "LOAN_REP", 180, r"ипотек"),
    ("LOAN_REP_04", "LOAN_REP", 182, r"резервирован\w+\s+средств.{0,30}погашен"),
    ("SEC_01", "SECURITIES", 190, r"(ценн\w*\s+бумаг|акции\s+(купл|продаж|торг)|облигаци\w+\s+(купл|погаш)|дивиденд|брокер|\bkase\b|\baix\b|фондов\w+\s+(рынок|биржа))"),
    ("GAMB_01", "GAMBLING", 190, r"\b(1xbet|betboom|olimp|pari\b|pin[\s\-]?up|melbet|fonbet|vinline|betcity|parimatch|casino|казино|букмекер|лотере|gambling|poker|покер)\b"),
    ("INV_01", "INVOICE", 190, r"(счет[- ]?фактур|счёт[- ]?фактур|invoice|инвойс)"),
    ("STATE_01", "STATE", 190, r"(гос\w*\s*выплат|соц\w*\s*выплат|единые?\s+пенсионные?\s+выплат|пенсионные?\s+(выплат|начислен)|пособи\w+\s*(по\s+)?безработиц)"),
    ("STATE_02", "STATE", 185, r"(пенсия|пенсионн\w+|пособие|субсиди|соцвыплат|\bенпф\b)"),
    ("MAND_01", "MANDATORY", 190, r"\b(кпн|ипн|иис|осмс|соп)\b"),
    ("MAND_02", "MANDATORY", 188, r"(уплата\s+ндс|оплата\s+ндс|перечислен\w+\s+ндс|ндс\s+за\s|\bндс\s+от\s)"),
    ("MAND_03", "MANDATORY", 185, r"(налог|госпошлин|штраф|пеня|обязательн\w*\s+взнос|коммунал|квартплат|жкх|водоснабжен|теплоснабжен|электроэнерг|газоснабжен)"),
    ("MAND_04", "MANDATORY", 183, r"комисси\w+\s+(за\s+)?операц"),
    ("FX_01", "FX", 185, r"(конвертац|обмен\s+валют|forex|currency\s+exchange)"),
    ("FX_03", "FX", 175, r"(покупк[аи]\s+(usd|eur|rub)|продаж[аи]\s+(usd|eur|rub)|конверти\w+|валютн\w+\s+(операц|перевод))"),
    ("CASH_01", "CASH", 185, r"(снятие\s+наличн|выдача\s+наличн|получение\s+наличн|cash\s*withdrawal|cash\s*out|\batm\b|банкомат)"),
    ("CASH_02", "CASH", 170, r"наличн"),
    ("INT_ZP_DEP", "INTERNAL", 188, r"(зп\s+карт|зарплатн\w+\s+карт).{0,40}(депозит|вклад)|(депозит|вклад).{0,40}(зп\s+карт|зарплатн\w+\s+карт)"),
    ("SAL_01", "SALARY", 185, r"(заработн\w*\s+плат|зарплат|аванс\s+зп|зп\s+карт|\bsalary\b|payroll|жалақы|выплат\w*\s+зп)"),
    ("SAL_02", "SALARY", 178, r"(\bзп\b|оклад)"),
    ("REF_01", "REFUND", 185, r"(возврат|refund|сторно|chargeback|чарджбек)"),
    ("INT_DEPOSIT", "INTERNAL", 192, r"(причислени\w+\s+процент|выплат\w+\s+вознагражден\w+\s+по\s+вклад|процент\w+\s+по\s+(вклад|депозит|счет))"),
    ("INT_01", "INTERNAL", 182, r"(собственн\w+\s+средств|между\s+(своим|личн)\w*\s+счет|перенос\s+сумм|внутренн\w*\s+перевод)"),
    ("INT_02", "INTERNAL", 178, r"(со\s+счета\s+на\s+счет|с\s+депозит\w*\s+на|на\s+депозит|с\s+зп\s+карт\w*\s+на\s+депозит|с\s+карт\w*\s+на\s+депозит)"),
    ("INT_03", "INTERNAL", 165, r"депозит"),
    ("CONT_01", "CONTRACT", 175, r"(по\s+договор|согласно\s+договор|в\s+соответствии\s+с\s+договор|оплата\s+по\s+дог)"),
    ("CONT_02", "CONTRACT", 165, r"договор\s*[№#N]"),
    ("P2P_01", "P2P", 175, r"\bp2p\b"),
    ("P2P_02", "P2P", 172, r"card\s*to\s*card|cald\s*to\s*cald"),
    ("P2P_03", "P2P", 168, r"(перевод\s+физ\w*\s+лиц|перевод\s+между\s+карт|перевод\s+(частн\w+|физ)\s+лиц)"),
    ("CARD_01", "CARD", 162, r"(на\s+карту|на\s+карт\w+|платеж\s+на\s+карт|перевод\s+на\s+карт)"),
    ("TOPUP_01", "TOPUP", 165, r"(пополнен\w+\s+счет|взнос\s+наличн|cash\s*in|зачислен\w*\s+на\s+счет|приход\s+на\s+счет)"),
    ("TOPUP_02", "TOPUP", 155, r"пополнен"),
    ("CASH_TOPUP_01", "CASH_TOPUP", 176, r"(ресайклер|recycler|поступление\s+денежных\s+средств\s+через\s+ресайклер)"),
    ("STORE_01", "STORE", 160, r"(оплата\s+товар|покупк\w+|qr\s*pay|\bpos\b|\bmerchant\b|торгов\w*\s+точк|через\s+терминал)"),
    ("STORE_03", "STORE", 158, r"оплата\s+товаров\s+и\s+услуг"),
    ("STORE_02", "STORE", 150, r"(продажи\s+с\s|kaspi\.kz|kz\s+продаж|магазин|супермаркет|аптек)"),
    ("GEN_OPL", "CONTRACT", 100, r"(оплата\s+за\s+|оплата\s+услуг|оплата\s+работ)"),
]
RULE_CONFIDENCE = 0.95
#: The recycler comes before all rules.
RECYCLER = r"ресайклер|recycler"

#: Question topics, banks, month stems.
TOPICS = [
    (r"долг|займ|заем|кредит|погашен|loan|repayment", "loan"),
    (r"депозит|вклад|процент|вознагражден", "deposit"),
    (r"налог|ндс|кпн|tax", "tax"),
    (r"зарплат|оклад|salary|payroll", "salary"),
    (r"комисси|fee|сбор", "fee"),
    (r"коммун", "utilities"),
    (r"перевод|transfer", "transfer"),
    (r"банкомат|atm|наличн|cash", "atm_cash"),
    (r"покупк|purchase|магазин|shop", "purchase"),
    (r"штраф|пеня|penalty|fine", "penalty"),
    (r"аренд|rent|лизинг|lease", "rent_lease"),
    (r"недвижимост|квартир|ипотек|жиль|real estate|property", "real_estate"),
    (r"страхован|insurance", "insurance"),
    (r"дивиденд|dividend", "dividend"),
    (r"возврат|refund|возмещ", "refund"),
    (r"товар|услуг", "goods_services"),
]
BANKS = [(r"kaspi|каспи", "kaspi"), (r"halyk|халык|народн", "halyk"), (r"forte|форте", "forte"), (r"sber|сбер", "sber"), (r"jusan|джусан", "jusan"), (r"bereke|береке", "bereke"), (r"centercredit|центркредит", "centercredit"), (r"bcc|бцк", "bcc")]
MONTHS = [("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("мая", 5), ("май", 5), ("июн", 6), ("июл", 7), ("август", 8), ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12)]
IN_WORDS = r"входящ|кредитов|credit|incoming|зачислен|поступлен|доход|income|receipt|deposit"
OUT_WORDS = r"исходящ|дебетов|debit|outgoing|списан|расход|трат|expense|spend|outflow|withdraw"
LESS_WORDS, EQUAL_WORDS = r"меньше|менее|ниже|less than|под\b", r"равно|exactly|ровно"
AMOUNT_WORDS = r"больше|свыше|менее|меньше|ниже|выше|от|до|на сумму|сумм[аы]|amount|kzt|usd|eur|rub|тенге|доллар|евро|руб"
LARGE_WORDS = r"\b(больш(ие|ой|ая)|крупн(ые|ый|ая)|large|high-value)\b"

#: Column headers of statements, plain and grouped.
HEADERS = {
    "дата и время операции": "operation_ts", "дата операции": "operation_ts", "дата/время": "operation_ts", "дата": "operation_ts",
    "валюта операции": "currency", "валюта": "currency",
    "виды операции (категория документа)": "operation_type_raw", "виды операции": "operation_type_raw", "категория документа": "operation_type_raw",
    "наименование сдп (при наличии)": "sdp_name", "наименование сдп": "sdp_name", "сдп": "sdp_name",
    "код назначения платежа": "purpose_code", "назначение платежа": "purpose_text", "назначение": "purpose_text",
    "сумма в тенге": "amount_kzt", "сумма в валюте ее проведения": "amount_currency", "сумма в валюте её проведения": "amount_currency",
    "сумма в валюте ее проведения по кредиту": "amount_credit", "сумма в валюте ее проведения по дебету": "amount_debit", "сумма по кредиту": "amount_credit", "сумма по дебету": "amount_debit", "сумма": "amount_currency",
    "наименование/фио плательщика": "payer_name", "иин/бин плательщика": "payer_iin_bin", "резидентство плательщика": "payer_residency", "банк плательщика": "payer_bank", "счет плательщика": "payer_account", "номер счета плательщика": "payer_account",
    "наименование/фио получателя": "receiver_name", "иин/бин получателя": "receiver_iin_bin", "резидентство получателя": "receiver_residency", "банк получателя": "receiver_bank", "счет получателя": "receiver_account", "номер счета получателя": "receiver_account",
    **{f"{s}/{k}": f"{s}_{v}" for s in ("payer", "receiver") for k, v in (("name", "name"), ("iin_bin", "iin_bin"), ("iin", "iin_bin"), ("bin", "iin_bin"), ("residency", "residency"), ("bank", "bank"), ("account", "account"))},
}
HEADER_KEYWORDS = ["дата", "время", "операц", "валют", "сумм", "тенге", "назначен", "плательщик", "получатель", "иин", "бин", "счет", "номер счета", "банк", "резидент", "код назначения", "виды операции", "категория", "sdp", "сдп", "transaction", "date", "amount", "currency", "purpose", "payer", "receiver"]
#: Words in header rows of two banks' own layouts.
KASPI_MARKS = ["дата операции", "дата", "валюта", "сумма", "назначение", "виды операции", "категория документа"]
HALYK_MARKS = ["дата и время операции", "дата операции", "дата/время", "валюта операции", "сумма в тенге"]
GROUP_HEADERS = {"плательщик": "payer", "получатель": "receiver"}
SUBHEADERS = {"наименование/фио": "name", "иин/бин": "iin_bin", "резидентство": "residency", "банк": "bank", "бик": "bic", "номер счета": "account", "счет": "account"}
