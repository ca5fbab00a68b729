"""Recognition of source code by generalised LL parsing, one or more dialect grammars to a language."""
