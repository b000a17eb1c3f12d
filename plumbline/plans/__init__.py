"""Views, configuration, workflows, and the registered queries."""
