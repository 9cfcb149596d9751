"""Framework rules: what marks a file's entry points, where its input comes from, and what is dangerous to call.

Fixed values, in the order in which they are tried.
"""

from __future__ import annotations

# fixed values: language: kind, framework, module, pattern (a part of the text, or regex:...), multiplier
ENTRY_POINTS = {
    "python": (
        ("web_route", "flask", "flask", "@app.route", 2.0), ("web_route", "flask", "flask", ".route(", 2.0), ("web_route", "flask", "flask", "Blueprint(", 2.0),
        ("web_route", "fastapi", "fastapi", "@app.get", 2.0), ("web_route", "fastapi", "fastapi", "@app.post", 2.0), ("web_route", "fastapi", "fastapi", "@app.put", 2.0),
        ("web_route", "fastapi", "fastapi", "@app.delete", 2.0), ("web_route", "fastapi", "fastapi", "@router.", 2.0), ("web_route", "django", "django.urls", "urlpatterns", 2.0),
        ("web_route", "django", "django.http", r"regex::\s*HttpRequest\b", 2.0), ("web_route", "django", "django.views", "View", 2.0), ("web_route", "drf", "rest_framework", "APIView", 2.0),
        ("web_route", "drf", "rest_framework", "@api_view", 2.0), ("web_route", "fastapi", "fastapi", "APIRouter(", 2.0), ("web_route", "starlette", "starlette", "Route(", 2.0),
        ("web_route", "flask", "flask", ".add_url_rule(", 2.0), ("web_view", "django", "django.views", r"regex:^\s*class\s+\w+View\b", 2.0),
        ("cli_command", "click", "click", "@click.command", 0.5), ("cli_command", "click", "click", "@cli.command", 0.5), ("cli_command", "typer", "typer", "@app.command", 0.5),
        ("cli_command", "argparse", "argparse", "ArgumentParser(", 0.5), ("cli_command", "argparse", "argparse", "parse_args(", 0.5),
        ("task_worker", "celery", "celery", "@app.task", 1.5), ("task_worker", "rq", "rq", "Queue(", 1.5), ("lambda_handler", "aws_lambda", "", "def lambda_handler", 2.0)),
    "javascript": (
        ("web_route", "express", "express", "app.get(", 2.0), ("web_route", "express", "express", "app.post(", 2.0), ("web_route", "express", "express", "app.put(", 2.0),
        ("web_route", "express", "express", "app.delete(", 2.0), ("web_route", "express", "express", "router.", 2.0), ("web_route", "koa", "koa", "router.", 2.0),
        ("web_route", "fastify", "fastify", "fastify.", 2.0), ("web_route", "hapi", "@hapi/hapi", "server.route", 2.0), ("lambda_handler", "aws_lambda", "", "exports.handler", 2.0),
        ("worker_handler", "cloudflare_workers", "", "addEventListener('fetch'", 2.0), ("cli_command", "commander", "commander", ".command(", 0.5),
        ("cli_command", "yargs", "yargs", "yargs(", 0.5), ("build_script", "stdlib", "", "#!/usr/bin/env node", 0.5)),
    "typescript": (
        ("web_route", "next", "next", r"regex:(?m)^\s*export\s+(default\s+)?async\s+function\s+(GET|POST|PUT|DELETE|PATCH)\s*\(", 2.0),
        ("web_route", "next_pages", "next", "export default function handler", 2.0), ("web_route", "nestjs", "@nestjs/common", "@Controller(", 2.0),
        ("web_route", "nestjs", "@nestjs/common", "@Get(", 2.0), ("web_route", "nestjs", "@nestjs/common", "@Post(", 2.0),
        ("web_route", "remix", "@remix-run", r"regex:(?m)^\s*export\s+(const|async\s+function|function)\s+action\b", 2.0),
        ("web_route", "remix", "@remix-run", r"regex:(?m)^\s*export\s+(const|async\s+function|function)\s+loader\b", 1.8),
        ("web_route", "sveltekit", "@sveltejs/kit", r"regex:(?m)^\s*export\s+(const|async\s+function|function)\s+POST\b", 2.0),
        ("web_route", "sveltekit", "@sveltejs/kit", r"regex:(?m)^\s*export\s+(const|async\s+function|function)\s+GET\b", 2.0),
        ("rpc_handler", "trpc", "@trpc/server", ".mutation(", 1.8), ("rpc_handler", "trpc", "@trpc/server", ".query(", 1.8), ("web_route", "hono", "hono", ".get(", 2.0),
        ("web_route", "hono", "hono", ".post(", 2.0), ("worker_handler", "cloudflare_workers", "", "export default {", 2.0)),
}
# fixed values: language: kind, framework, module, pattern
INPUTS = {
    "python": (
        ("http_request", "flask", "flask", "request.args"), ("http_request", "flask", "flask", "request.form"), ("http_request", "flask", "flask", "request.json"), ("http_request", "flask", "flask", "request.data"),
        ("http_request", "flask", "flask", "request.values"), ("http_request", "flask", "flask", "request.cookies"), ("http_request", "flask", "flask", "request.headers"),
        ("http_request", "fastapi", "fastapi", "Body("), ("http_request", "fastapi", "fastapi", "Query("), ("http_request", "fastapi", "fastapi", "Form("),
        ("http_request", "django", "django", "request.GET"), ("http_request", "django", "django", "request.POST"), ("http_request", "django", "django", "request.body"),
        ("env_input", "stdlib", "os", "os.environ"), ("stdin_input", "stdlib", "sys", "sys.stdin"), ("argv_input", "stdlib", "sys", "sys.argv")),
    "javascript": (
        ("http_request", "express", "express", "req.body"), ("http_request", "express", "express", "req.query"), ("http_request", "express", "express", "req.params"), ("http_request", "express", "express", "req.cookies"),
        ("http_request", "express", "express", "req.headers"), ("env_input", "stdlib", "", "process.env"), ("argv_input", "stdlib", "", "process.argv"), ("stdin_input", "stdlib", "", "process.stdin")),
    "typescript": (
        ("http_request", "next", "next", "request.json()"), ("http_request", "next", "next", "request.formData()"), ("http_request", "next", "next", "request.headers"), ("http_request", "next", "next", "searchParams.get"),
        ("http_request", "nestjs", "@nestjs/common", "@Body("), ("http_request", "nestjs", "@nestjs/common", "@Query("), ("http_request", "nestjs", "@nestjs/common", "@Param("), ("http_request", "remix", "@remix-run", "request.formData")),
}
# fixed values: language: kind, framework, module, pattern, bump, what the line must hold too, and what as well for rules that name it
SINKS = {
    "python": (
        ("sql_execution", "sqlite3", "sqlite3", ".execute(", 1, ""), ("sql_execution", "psycopg2", "psycopg2", ".execute(", 1, ""), ("sql_execution", "django.db", "django.db", ".raw(", 1, ""),
        ("sql_execution", "sqlalchemy", "sqlalchemy", "text(", 1, ""), ("sql_execution", "pymysql", "pymysql", ".execute(", 1, ""),
        ("shell_execution", "subprocess", "subprocess", "subprocess.run", 1, "shell=True"), ("shell_execution", "subprocess", "subprocess", "subprocess.call", 1, "shell=True"),
        ("shell_execution", "subprocess", "subprocess", "subprocess.Popen", 1, "shell=True"), ("shell_execution", "stdlib", "os", "os.system(", 1, ""),
        ("code_execution", "stdlib", "", "eval(", 2, ""), ("code_execution", "stdlib", "", "exec(", 2, ""), ("deserialization", "pickle", "pickle", "pickle.load", 1, ""), ("deserialization", "pickle", "pickle", "pickle.loads", 1, ""),
        ("deserialization", "yaml", "yaml", "yaml.load(", 1, "!Loader=SafeLoader"), ("ssrf", "requests", "requests", "requests.get", 1, ""), ("ssrf", "requests", "requests", "requests.post", 1, ""), ("ssrf", "urllib", "urllib", "urlopen(", 1, "")),
    "javascript": (
        ("sql_execution", "mysql", "mysql", ".query(", 1, ""), ("sql_execution", "pg", "pg", ".query(", 1, ""), ("sql_execution", "sqlite3", "sqlite3", ".exec(", 1, ""), ("sql_execution", "knex", "knex", ".raw(", 1, ""),
        ("shell_execution", "child_process", "child_process", "exec(", 1, ""), ("shell_execution", "child_process", "child_process", "execSync(", 1, ""), ("shell_execution", "child_process", "child_process", "spawn(", 1, ""),
        ("code_execution", "stdlib", "", "eval(", 2, ""), ("code_execution", "vm", "vm", "vm.runInNewContext", 2, ""), ("ssrf", "stdlib", "", "fetch(", 1, ""), ("ssrf", "axios", "axios", "axios.", 1, ""), ("ssrf", "http", "http", "http.request(", 1, ""),
        ("xss_sink", "react", "react", "dangerouslySetInnerHTML", 1, ""), ("xss_sink", "stdlib", "", ".innerHTML", 1, ""), ("xss_sink", "stdlib", "", "document.write(", 1, ""), ("deserialization", "stdlib", "", "JSON.parse(", 1, "")),
    "typescript": (
        ("sql_execution", "prisma", "@prisma/client", ".$queryRaw", 1, ""), ("sql_execution", "prisma", "@prisma/client", ".$executeRaw", 1, ""), ("sql_execution", "drizzle", "drizzle-orm", ".execute(", 1, ""),
        ("xss_sink", "react", "react", "dangerouslySetInnerHTML", 1, ""), ("server_action", "next", "", "'use server'", 1, "")),
}
LANGUAGES = {
    ".py": ("python",), ".pyi": ("python",), ".js": ("javascript",), ".mjs": ("javascript",), ".cjs": ("javascript",), ".jsx": ("javascript",),
    ".ts": ("typescript", "javascript"), ".tsx": ("typescript", "javascript"),
}
HEAD = 64 * 1024
