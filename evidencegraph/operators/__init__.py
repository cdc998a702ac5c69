"""DataFrame operators over messages, entities, edges and reports."""
