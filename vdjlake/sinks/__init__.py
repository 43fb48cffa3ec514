"""Writers: stage tables, FASTA, CSV reports and workbooks as folders of tables."""
