"""Schemas of the stored tables and of landed files, as DDL; nothing is inferred."""

RECORDS = "accession string, title string, summary string, overall_design string, organism_text string, organisms array<string>, platforms array<string>, tech_type string, pubmed_ids array<string>, submission_date timestamp, last_update_date timestamp, sample_count int, raw_record string, created_at timestamp, updated_at timestamp"
VOCABULARY = "concept_id string, descriptor_ui string, preferred_name string, entry_terms array<string>, tree_numbers array<string>"
LINKS = "accession string, concept_id string, source string, confidence double"
RUNS = "run_id long, query string, start_time timestamp, end_time timestamp, status string, total_count int, success_count int, error_count int, run_metadata string"
ITEMS = "run_id long, accession string, status string, error_message string, fetch_time timestamp, process_time timestamp"
VECTORS = "accession string, embedding array<float>"
RAW = "accession string, title string, summary string, overall_design string, type string, platform_ids array<string>, sample_ids array<string>, pubmed_ids array<string>, taxon string, entrez_date string, submission_date string, n_samples string, organisms array<string>, error string"
#: One entry of a summary response.
SUMMARY = "accession string, title string, summary string, gdstype string, gpl string, taxon string, pdat string, n_samples string"
#: A vocabulary file's record element.
DESCRIPTOR = "DescriptorUI string, DescriptorName struct<String: string>, ConceptList struct<Concept: array<struct<TermList: struct<Term: array<struct<String: string>>>>>>, TreeNumberList struct<TreeNumber: array<string>>"
#: A document summary element.
DOCSUM = "Accession string, title string, summary string, overall_design string, gdsType string, GPL array<string>, GSM array<string>, PubMedIds struct<int: array<string>>, taxon string, PDAT string, n_samples string, Samples struct<Sample: array<struct<Organism: string>>>, Contributor array<string>"
SOURCES = ("auto", "pubmed", "manual")
RUN_STATES = ("running", "completed", "failed", "partial")
ITEM_STATES = ("pending", "fetching", "parsing", "storing", "completed", "failed")
