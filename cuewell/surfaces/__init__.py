"""Ways in for callers that send one request at a time: command line, shell, lines, HTTP, tools.

All run the same verbs over one ``Session``; batch work uses the operators or ``plans.ops`` directly.
"""
