"""Notes on what a function does beyond its return value, found by tables of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (language, note, patterns in the source of which one is enough, annotations of which one is enough), in order.
RULES: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("java", "Sends email", (r"\b(?:JavaMailSender|SimpleMailMessage|MimeMessage|MimeMessageHelper|mailSender|javaMailSender|emailSender)\b",), ()),
    ("java", "Makes outbound HTTP request", (r"\b(?:RestTemplate|WebClient|FeignClient|HttpClient|OkHttpClient|CloseableHttpClient|HttpClientBuilder|restTemplate|webClient|httpClient|feignClient|okHttpClient|closeableHttpClient)\b",), ()),
    ("java", "Publishes Spring application event", (r"\.publishEvent\s*\(", r"\b[Aa]pplicationEventPublisher\b"), ()),
    ("java", "Enqueues background job", (r"\b(?:taskExecutor|threadPoolTaskExecutor|asyncTaskExecutor|TaskExecutor)\b.*\.(?:execute|submit)\s*\(", r"\bCompletableFuture\.(?:runAsync|supplyAsync)\s*\("), ("Async",)),
    ("java", "Sends message to broker (JMS, AMQP, or Kafka)", (r"\b(?:JmsTemplate|RabbitTemplate|KafkaTemplate|jmsTemplate|rabbitTemplate|kafkaTemplate|kafka)\b",), ()),
    ("java", "Executes within a database transaction (@Transactional)", (), ("Transactional", "TransactionAttribute")),
    ("java", "Executes within a database transaction (TransactionTemplate)", (r"\b[Tt]ransactionTemplate\b", r"\bPlatformTransactionManager\b"), ()),
    ("java", "Calls stored procedure", (r"\.createStoredProcedureQuery\s*\(", r"\.prepareCall\s*\(", r"\bSimpleJdbcCall\b"), ()),
    ("java", "Mutates application cache (@CacheEvict / @CachePut)", (), ("CacheEvict", "CachePut")),
    ("java", "Executes external process", (r"\bRuntime\.getRuntime\s*\(\s*\)\s*\.exec\s*\(", r"\bProcessBuilder\b"), ()),
    ("java", "Writes to file system", (r"\bFiles\.(?:write|delete|deleteIfExists|move|copy|createDirectories|createDirectory|createFile|createTempFile|createTempDirectory)\s*\(", r"\b(?:FileWriter|FileOutputStream|BufferedWriter|PrintWriter|OutputStreamWriter)\b", r"\bMultipartFile\b", r"\.transferTo\s*\("), ()),
    ("ruby", "Sends email (ActionMailer)", (r"\.\s*deliver_(?:later|now|later!|now!)",), ()),
    ("ruby", "Enqueues background job", (r"\bperform_(?:later|async|in|at)\s*\(",), ()),
    ("ruby", "Sends message to broker (Bunny / Karafka)", (r"\bBunny\.new\s*\(", r"\bKarafka\.producer\.produce_(?:sync|async)\s*\(", r"\bkafka\.deliver_message\s*\("), ()),
    ("ruby", "Makes outbound HTTP request", (r"\b(?:HTTParty|Faraday|RestClient)\b", r"Net::HTTP\b"), ()),
    ("ruby", "Executes external process", (r"\bsystem\s*[(\"']", r"`[^`\n]+`", r"\bIO\.popen\b", r"\bProcess\.(?:spawn|exec)\b", r"\bOpen3\.(?:popen3|capture3|capture2|capture2e|popen2|popen2e)\b"), ()),
    ("ruby", "Mutates application cache", (r"\bRails\.cache\.(?:write|write_multi|delete|delete_matched|delete_multi|clear)\b",), ()),
    ("ruby", "Executes within a database transaction", (r"\.transaction\s*(?:do\b|\{|\()",), ()),
    ("ruby", "Calls stored procedure", (r"\bexec_stored_procedure\s*\(", r"(?i)\.execute\s*\(\s*[\"']\s*(?:CALL|EXEC)\s+"), ()),
    ("ruby", "Writes to file system", (r"\bFile\.(?:write|binwrite|delete|rename|truncate|unlink|chmod|chown)\s*\(", r"\bIO\.(?:write|binwrite)\s*\(", r"\bFile\.open\s*\(\s*[^,)]+,\s*[\"'][wa]", r"\bFileUtils\.(?:cp|cp_r|mv|rm|rm_f|rm_rf|mkdir|mkdir_p|touch|chmod|chown|ln|ln_s|remove)\b", r"\bDir\.(?:mkdir|rmdir|delete|unlink)\s*\("), ()),
    ("python", "Sends email (Django mail)", (r"\b(?:send_mail|send_mass_mail|mail_admins|mail_managers|EmailMessage|EmailMultiAlternatives)\s*\(",), ()),
    ("python", "Makes outbound HTTP request", (r"\b(?:requests|httpx)\.(?:get|post|put|patch|delete|head|options|request)\s*\(", r"\burllib\.request\.urlopen\s*\("), ()),
    ("python", "Enqueues background job", (r"\.delay\s*\(", r"\.apply_async\s*\("), ()),
    ("python", "Sends message to broker (Kombu / Pika)", (r"\bchannel\.basic_publish\s*\(", r"\bproducer\.publish\s*\(", r"\bKafkaProducer\s*\(", r"\bproducer\.produce\s*\("), ()),
    ("python", "Calls stored procedure", (r"\.callproc\s*\(",), ()),
    ("python", "Executes external process", (r"\bsubprocess\.(?:run|Popen|call|check_call|check_output|getoutput|getstatusoutput)\s*\(", r"\bos\.(?:system|popen|exec[a-z]*|spawn[a-z]*)\s*\("), ()),
    ("python", "Mutates application cache", (r"\bcaches?(?:\[[^\]]+\])?\.(?:set|set_many|add|delete|delete_many|delete_pattern|clear|incr|decr|touch)\s*\(",), ()),
    ("python", "Executes within a database transaction", (r"\btransaction\.atomic\b",), ()),
    ("python", "Writes to file system", (r"\bopen\s*\((?:[^()]|\([^()]*\))*,\s*[\"'][wax][b+]*[\"']", r"\bos\.(?:remove|unlink|rename|rmdir|makedirs|mkdir|replace|symlink|link|chmod|chown)\s*\(", r"\bshutil\.(?:copy|copyfile|copytree|copy2|copymode|move|rmtree)\s*\(", r"\.write_text\s*\(", r"\.write_bytes\s*\(", r"\bdefault_storage\.(?:save|delete)\s*\("), ()),
    ("cfml", "Sends email (cfmail)", (r"(?i)<cfmail\b", r"(?i)\bcfmail\s*\("), ()),
    ("cfml", "Makes outbound HTTP request (cfhttp)", (r"(?i)<cfhttp\b", r"(?i)\bcfhttp\s*\("), ()),
    ("cfml", "Makes outbound HTTP request (cfinvoke webservice)", (r"(?i)<cfinvoke\b[^>]*\bwebservice\s*=", r"(?i)\bCreateObject\s*\(\s*[\"']webservice[\"']", r"(?i)<cfobject\b[^>]*\btype\s*=\s*[\"']webservice[\"']"), ()),
    ("cfml", "Enqueues background job (cfthread)", (r"(?i)<cfthread\b[^>]*\baction\s*=\s*[\"']run[\"']", r"(?i)\bcfthread\s*\([^)]*\baction\s*=\s*[\"']run[\"']"), ()),
    ("cfml", "Mutates application cache (cfcache)", (r"(?i)\bcache(?:Put|Remove|RemoveAll|Clear)\s*\(", r"(?i)<cfcache\b[^>]*\baction\s*=\s*[\"'](?:flush|put)[\"']"), ()),
    ("cfml", "Writes to file system (cffile)", (r"(?i)<cffile\b[^>]*\baction\s*=\s*[\"'](?:write|upload|uploadall|append|delete|move|rename|copy)[\"']", r"(?i)\b(?:fileWrite|fileAppend|fileDelete|fileMove|fileCopy|fileUpload|fileUploadAll)\s*\("), ()),
    ("cfml", "Executes external process (cfexecute)", (r"(?i)<cfexecute\b", r"(?i)\bcfexecute\s*\("), ()),
    ("cfml", "Executes database operations inside a transaction (cftransaction)", (r"(?i)<cftransaction\b", r"(?i)\btransaction\s*(?:\{|action\s*=)", r"(?i)\bcftransaction\s*\("), ()),
)
# Annotations that guard a Java class or method.
JAVA_GUARDS = tuple("Secured PreAuthorize PostAuthorize RolesAllowed PermitAll DenyAll PreFilter PostFilter".split())
# Hooks of an application file, with what they do.
HOOKS = {
    "onapplicationstart": "fires once when the application starts or is reloaded; initializes application-scope shared resources",
    "onapplicationend": "fires when the application times out or is stopped; cleans up shared resources",
    "onsessionstart": "fires when a new user session is created",
    "onsessionend": "fires when a user session times out or is explicitly ended",
    "onrequeststart": "fires before EVERY request to the application; used for authentication checks, logging, or shared request setup",
    "onrequestend": "fires after EVERY request completes",
    "onrequest": "intercepts every request; must explicitly invoke the requested template or the request will not be handled",
    "onerror": "fires when an uncaught exception occurs anywhere in the application",
    "onmissingtemplate": "fires when a requested .cfm template cannot be found (404 equivalent)",
    "oncfcrequest": "fires when this CFC is invoked directly via URL or web service",
    "onabort": "fires when cfabort or cfsilent is called within a request",
}
ENTITY_NOTE = "ColdFusion ORM persistent entity (Hibernate-mapped): table mapping is automatic unless overridden with the table attribute; read/write via entityLoad / entitySave"


def side_effects(language: Column, source: Column, annotations: Column | None = None) -> Column:
    """The notes of a function, in the order of the rules. Built-in expressions: a rule is a pattern on the source or a look at the annotations."""
    made = []
    for lang, note, patterns, marks in RULES:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.rlike(source, F.lit(p))
        if marks and annotations is not None:
            hit = hit | F.arrays_overlap(annotations, F.array(*(F.lit(m) for m in marks)))
        made.append(F.when((language == lang) & F.coalesce(hit, F.lit(False)), note))
    return F.array_compact(F.array(*made))


def guards(annotations: Column) -> Column:
    """The note of a Java function's guards; null without any."""
    own = F.filter(annotations, lambda a: a.isin(*JAVA_GUARDS))
    return F.when(F.size(own) > 0, F.concat(F.lit("auth: "), F.array_join(own, ", ")))


def hook_note(name: Column) -> Column:
    """What a hook of an application file does; null for other names."""
    out = F.lit(None).cast("string")
    for hook, what in HOOKS.items():
        out = F.when(F.lower(name) == hook, F.lit("ColdFusion lifecycle hook: " + what)).otherwise(out)
    return out


def is_entity(source: Column) -> Column:
    """Whether a component is persistent, in a tag or in script."""
    return F.rlike(source, F.lit(r"(?i)<cfcomponent\b[^>]*\bpersistent\s*=\s*[\"']true[\"']")) | F.rlike(source, F.lit(r"(?i)\bcomponent\b[^{]*\bpersistent\s*=\s*[\"']true[\"']"))


def _listed(source: Column, label: str, *patterns: str, lower: bool = False, prefix: str = "") -> Column:
    found = F.concat(*(F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in patterns))
    found = F.array_distinct(F.transform(found, lambda x: F.concat(F.lit(prefix), F.lower(x) if lower else x)))
    return F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(found, ", ")))


def markup_notes(source: Column) -> Column:
    """Notes of a CFML function that list what they found: events, mapper calls, custom tags, components, stored procedures."""
    quoted = r"[\"']([^\"']+)[\"']"
    events = F.regexp_extract_all(source, F.lit(rf"(?i)announceEvent\s*\(\s*{quoted}"), F.lit(1))
    modules = F.transform(F.regexp_extract_all(source, F.lit(r"(?i)<cfmodule\b[^>]*?\b(?:template|name)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: F.concat(F.lit("cfmodule:"), x))
    tags = F.transform(F.regexp_extract_all(source, F.lit(r"<cf_([a-zA-Z_][a-zA-Z0-9_]*)\b"), F.lit(1)), lambda x: F.concat(F.lit("cf_"), F.lower(x)))
    custom = F.array_distinct(F.concat(tags, modules))
    return F.array_compact(
        F.array(
            F.when(F.size(events) > 0, F.concat(F.lit("Fires plugin events: "), F.array_join(events, ", "))),
            _listed(source, "Calls ORM functions: ", r"(?i)\b(entity(?:Load|New|Save|Delete|LoadByPK|ToQuery|Count|NameArray)|orm(?:Flush|Reload|Evict|GetSession|ExecuteQuery))\s*\(", lower=True),
            F.when(F.size(custom) > 0, F.concat(F.lit("Invokes custom tags: "), F.array_join(custom, ", "))),
            _listed(source, "Dynamically instantiates components: ", rf"(?i)createObject\s*\(\s*[\"']component[\"']\s*,\s*{quoted}"),
        )
    )


def procedure_note(source: Column) -> Column:
    """The stored procedures that a CFML function names in tags, script blocks or calls; null without any."""
    name = r"\bprocedure\s*=\s*[\"']([^\"']+)[\"']"
    return _listed(source, "Calls stored procedure(s): ", rf"(?i)<cfstoredproc\b[^>]*{name}", rf"(?i)\bstoredproc\b[^{{]*?{name}", rf"(?i)\bcfstoredproc\s*\(\s*[^)]*?{name}")
