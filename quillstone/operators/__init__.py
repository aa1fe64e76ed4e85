"""DataFrame operators over pages, candidates, boxes, tables and logits."""
